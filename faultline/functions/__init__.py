"""Column-level functions: text normalisation, masks, levels, keyword rules."""
