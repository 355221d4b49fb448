"""Corpus analytics on Spark: tagged-token tables, frequency, keyness, collocation and concordance operators."""

from importlib import import_module

__version__ = "0.1.0"

_FROM = {
    "analyzers": ["Corpus", "Tokens", "convert_corpus"],
    "operators.dispersion": ["dispersions_table"],
    "operators.frequency": ["frequency_table", "tags_dtm", "tags_table"],
    "operators.keyness": ["keyness_table"],
    "operators.matrices": ["dtm_simplify", "dtm_to_coo", "dtm_weight", "freq_simplify", "tags_simplify"],
    "operators.sequences": ["clusters_by_tag", "clusters_by_token", "coll_table", "kwic_center_node", "ngrams", "tag_ruler"],
    "operators.tagger": ["FunctionTagger", "Pretagged", "RuleTagger"],
    "operators.tokens": ["parse"],
    "sources.text": ["corpus_from_file", "corpus_from_folder", "corpus_from_table", "get_text_paths", "readtext", "sample_tokens"],
}
_WHERE = {name: module for module, names in _FROM.items() for name in names}
__all__ = list(_WHERE)


def __getattr__(name: str):
    """Imports on demand: Python workers import this package for a module or two of it."""
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
