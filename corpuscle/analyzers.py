"""The operators as methods: a corpus that is parsed, and a tokens table that is asked."""

from __future__ import annotations

import warnings
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession

from corpuscle import validation
from corpuscle.operators import dispersion, frequency, keyness, matrices, sequences
from corpuscle.operators.tagger import Pretagged, Tagger
from corpuscle.operators.tokens import finish, parse
from corpuscle.sources import text


class Tokens:
    """A tokens table. kept() holds it in memory and on disk for the next questions; release() lets it go."""

    #: Results that cached() keeps; the one longest unused goes first.
    MOST = 128

    def __init__(self, table: DataFrame):
        self.table = table
        self._results: OrderedDict[tuple, DataFrame] = OrderedDict()

    @classmethod
    def from_tagged(cls, tagged: DataFrame) -> "Tokens":
        """Of tokens that were tagged elsewhere, with ds_tag, or with iob and label."""
        return cls(finish(Pretagged(tagged).tag()))

    def kept(self) -> "Tokens":
        self.table = self.table.persist()
        return self

    def release(self) -> "Tokens":
        """Lets go of what kept() and cached() hold."""
        self.table = self.table.unpersist()
        for result in self._results.values():
            result.unpersist()
        self._results.clear()
        return self

    def cached(self, operator: str, *args, **how) -> DataFrame:
        """The result of one of the methods below that give one table, held for the next call with the same parameters."""
        key = (operator, args, tuple(sorted(how.items())))
        if key not in self._results:
            self._results[key] = getattr(self, operator)(*args, **how).persist()
            if len(self._results) > self.MOST:
                self._results.popitem(last=False)[1].unpersist()
        self._results.move_to_end(key)
        return self._results[key]

    def why_empty(self, operator: str, result: DataFrame) -> list[str]:
        """What to try if result, of ngrams, clusters, kwic, collocations or keyness, has no rows; nothing if it has."""
        return validation.why_empty(operator) if result.isEmpty() else []

    def frequencies(self, count_by: str = "pos", **bounds):
        return frequency.frequency_table(self.table, count_by, **bounds)

    def tags(self, count_by: str = "pos"):
        return frequency.tags_table(self.table, count_by)

    def dtm(self, count_by: str = "pos", tags: list[str] | None = None):
        return frequency.tags_dtm(self.table, count_by, tags)

    def dispersions(self, count_by: str = "pos") -> DataFrame:
        return dispersion.dispersions_table(self.table, count_by)

    def ngrams(self, span: int = 2, min_frequency: float = 10, count_by: str = "pos", **how) -> DataFrame:
        return sequences.ngrams(self.table, span, min_frequency, count_by, **how)

    def clusters(self, node_word: str | None = None, tag: str | None = None, position: int = 1, span: int = 2, count_by: str = "pos", **how) -> DataFrame:
        """By a word or by a tag, one of which is given."""
        if (node_word is None) == (tag is None):
            raise ValueError("clusters are of a node_word or of a tag")
        if tag is not None:
            return sequences.clusters_by_tag(self.table, tag, position, span, count_by, **how)
        return sequences.clusters_by_token(self.table, node_word, position, span, count_by=count_by, **how)

    def kwic(self, node_word: str, **how) -> DataFrame:
        return sequences.kwic_center_node(self.table, node_word, **how)

    def collocations(self, node_word: str, **how) -> DataFrame:
        return sequences.coll_table(self.table, node_word, **how)

    def keyness(self, reference: "Tokens", tags_only: bool = False, count_by: str = "pos", **how) -> DataFrame:
        a, b = ((t.tags(count_by) if tags_only else t.frequencies(count_by)) for t in (self, reference))
        return keyness.keyness_table(a, b, tags_only=tags_only, **how)

    def ruler(self, doc_id: str | int, count_by: str = "pos") -> DataFrame:
        return sequences.tag_ruler(self.table, doc_id, count_by)


class Corpus:
    """A corpus (doc_id, text)."""

    def __init__(self, table: DataFrame):
        self.table = table

    @classmethod
    def from_folder(cls, spark: SparkSession, directory: str, recursive: bool = False) -> "Corpus":
        return cls(text.corpus_from_folder(spark, directory, recursive))

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, doc_id: str = "doc_id", text_column: str = "text") -> "Corpus":
        return cls(text.corpus_from_file(spark, path, doc_id, text_column))

    def parsed(self, tagger: Tagger | None = None, **how) -> Tokens:
        return Tokens(parse(self.table, tagger, **how))


def convert_corpus(*tables: DataFrame) -> Tokens:
    """An older name of Tokens.from_tagged."""
    if len(tables) != 1:
        raise TypeError(f"convert_corpus takes one table of tagged tokens, not {len(tables)}")
    warnings.warn("use Tokens.from_tagged", DeprecationWarning, stacklevel=2)
    return Tokens.from_tagged(tables[0])


weight, simplify, simplify_frequencies, simplify_tags, coo = matrices.dtm_weight, matrices.dtm_simplify, matrices.freq_simplify, matrices.tags_simplify, matrices.dtm_to_coo
