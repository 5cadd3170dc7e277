"""The query modules of the subpackage."""

from failscope.llm import bpe, consensus, grouped_split, leakage, pairs, residue, splits_overlap, truncation

MODULES = [pairs, truncation, consensus, splits_overlap, grouped_split, bpe, leakage, residue]
