"""Relational operators: consistency evidence, black-box scores, fusion, metrics, masking, resuming and merging."""
