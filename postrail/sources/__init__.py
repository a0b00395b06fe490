"""Where posting lists and queries come from and go to."""

from .files import keys_from, lines_of_queries, read_docs, read_queries, sample_lists, write_docs, write_keys
from .tables import numbered, postings, postings_of_terms, validate
from .store import Index, load_codes, load_index, load_lists, save_codes, save_index, scratch, settle

__all__ = ["Index", "keys_from", "lines_of_queries", "load_codes", "load_index", "load_lists", "numbered", "postings", "postings_of_terms", "read_docs", "read_queries", "sample_lists", "save_codes", "save_index", "scratch", "settle", "validate", "write_docs", "write_keys"]
