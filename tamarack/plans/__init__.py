"""From statement text to a DataFrame: tokens, syntax tree, resolution and lowering."""
