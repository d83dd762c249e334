"""Live forms of batch operators (ours; the batch forms define the results)."""
