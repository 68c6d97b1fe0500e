"""Full-text search on Spark DataFrames: BM25+ ranking over an inverted index kept as tables."""

from lodestone.functions.analysis import Analyzer, PythonAnalyzer
from lodestone.operators.index import IndexConfig, TextIndex
from lodestone.operators.search import auto_suggest, search, search_batch
from lodestone.plans.query import WILDCARD, SearchError, Tree, tree

__all__ = ["WILDCARD", "Analyzer", "IndexConfig", "PythonAnalyzer", "SearchError", "TextIndex", "Tree", "auto_suggest", "search", "search_batch", "tree"]
