"""Incremental evidence over a growing folder of cells; an extension of the batch operators."""
