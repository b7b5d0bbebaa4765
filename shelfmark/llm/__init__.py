"""Training-data operators: grouping, fusion, incremental matching, vector
search, tokenising, mixing and repair of garbled text. Nothing outside this
subpackage imports it."""
