"""Taggers make raw tokens (doc_id, tok_idx, token, ws, pos_tag, ds_tag) from a clean corpus (doc_id, text).

The rule tagger is a deterministic stand-in for a trained model: a tokeniser, a lexicon of closed classes, suffix rules and a few
multi-word units, as one projection of SQL expressions. The same rules render as DuckDB SQL. A trained model comes in
through FunctionTagger, whose function runs on Arrow batches of documents in Python workers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.errors import TaggerMismatch
from corpuscle.schema import RAW_TOKENS
from corpuscle.validation import require

#: A word of letters, a number, or a single sign; each with the white space after it.
TOKEN = "[A-Za-z]+\\s*|[0-9]+\\s*|[^A-Za-z0-9\\s]\\s*"

POS_WORDS = {
    "AT": "the no every", "AT1": "a an", "IO": "of", "CC": "and or", "CCB": "but", "TO": "to", "IW": "with without", "IF": "for",
    "II": "in on at by from into over under about between through", "VBZ": "is", "VBDZ": "was", "VBR": "are", "VBDR": "were", "VBI": "be",
    "VBN": "been", "VHZ": "has", "VH0": "have", "VHD": "had", "VDZ": "does", "VD0": "do", "VDD": "did", "VM": "will would can could may might shall should must",
    "PPH1": "it", "PPHS1": "he she", "PPHS2": "they", "PPHO2": "them", "PPIS1": "i", "PPIS2": "we", "PPY": "you", "APPGE": "his her their its my our your",
    "CST": "that", "DD1": "this", "DD2": "these those", "DDQ": "which what", "PNQS": "who", "CSA": "as", "CS": "if because while", "CSN": "than",
    "XX": "not", "EX": "there", "DA": "such", "RR": "so very also", "MC1": "one", "MC": "two three four five", "PN1": "s",
}
POS_SUFFIXES = [("ing", "VVG"), ("ed", "VVD"), ("ly", "RR"), ("tion", "NN1"), ("ness", "NN1"), ("ment", "NN1"), ("ble", "JJ"), ("ous", "JJ"), ("ful", "JJ"), ("ive", "JJ"), ("est", "JJT"), ("s", "NN2")]
#: Two words that are one unit: both get the tag, numbered 21 and 22. No second word is the first of another unit.
POS_UNITS = {("such", "as"): "II", ("in", "that"): "CS", ("so", "that"): "CS"}

DS_WORDS = {
    "SyntacticComplexity": "and or but which", "Negative": "not no never", "Narrative": "was were had", "InformationStates": "is are",
    "MetadiscourseCohesive": "this these thus", "Future": "will would shall", "ConfidenceHedged": "may might could", "FirstPerson": "i we my our",
    "PublicTerms": "state law", "Description": "very",
}
DS_SUFFIXES = [("ing", "InformationChange"), ("tion", "AcademicTerms"), ("ly", "ForceStressed")]
DS_UNITS = {("of", "the"): "InformationTopics", ("to", "be"): "Future", ("in", "that"): "Reasoning"}


def _words(words: dict[str, str]) -> str:
    return " ".join(f"WHEN {{w}} IN ({', '.join(repr(x) for x in some.split())}) THEN '{tag}'" for tag, some in words.items())


def _units(units: dict[tuple[str, str], str], first: str, second: str) -> str:
    return " ".join(f"WHEN {{w}} = '{a}' AND {{n}} = '{b}' THEN '{first.format(t)}' WHEN {{w}} = '{b}' AND {{p}} = '{a}' THEN '{second.format(t)}'" for (a, b), t in units.items())


def _suffixes(suffixes: list[tuple[str, str]], form: str) -> str:
    return " ".join(f"WHEN {{w}} LIKE '%{s}' AND length({{w}}) > {len(s)} THEN '{form.format(t)}'" for s, t in suffixes)


_POS = (_units(POS_UNITS, "{}21", "{}22"), "WHEN substr({w}, 1, 1) BETWEEN '0' AND '9' THEN 'MC' WHEN NOT substr({w}, 1, 1) BETWEEN 'a' AND 'z' THEN 'Y' " + _suffixes(POS_SUFFIXES, "{}") + " ELSE 'NN1' END")
_DS = (_units(DS_UNITS, "B-{}", "I-{}"), "WHEN substr({w}, 1, 1) BETWEEN '0' AND '9' THEN 'B-InformationExposition' " + _suffixes(DS_SUFFIXES, "B-{}") + " ELSE 'O-' END")
#: CASE expressions of {w}, the word in lower case, {n} the next and {p} the previous one, for DuckDB.
POS_CASE = f"CASE {_POS[0]} {_words(POS_WORDS)} {_POS[1]}"
DS_CASE = f"CASE {_DS[0]} {_words({f'B-{t}': w for t, w in DS_WORDS.items()})} {_DS[1]}"
#: Tags that the rules can give, after multi-word units are one: matrices with one column a tag have these.
POS_TAGS = sorted({*POS_WORDS, *(t for _, t in POS_SUFFIXES), *POS_UNITS.values(), "NN1", "GE"})
DS_TAGS = sorted({*DS_WORDS, *(t for _, t in DS_SUFFIXES), *DS_UNITS.values(), "InformationExposition", "Untagged"})
TAGS = {"pos": POS_TAGS, "ds": DS_TAGS}


class Tagger(Protocol):
    def tag(self, corpus: DataFrame) -> DataFrame:
        """Raw tokens of a corpus (doc_id, text)."""


def _lexicon() -> list[tuple]:
    """(w, pos, ds, and of the units that w begins on each layer, the second word and the tag; of those that it ends, the first words)."""
    pos = {w: t for t, some in POS_WORDS.items() for w in some.split()}
    ds = {w: f"B-{t}" for t, some in DS_WORDS.items() for w in some.split()}

    def of(units: dict[tuple[str, str], str], first: str, second: str, w: str) -> tuple:
        begins = [(b, first.format(t)) for (a, b), t in units.items() if a == w]
        ends = [(a, second.format(t)) for (a, b), t in units.items() if b == w]
        assert len(begins) <= 1 and len({t for _, t in ends}) <= 1, "a table row holds one unit that begins, and one tag of those that end"
        return (*(begins[0] if begins else (None, None)), [a for a, _ in ends] or None, ends[0][1] if ends else None)

    words = {*pos, *ds, *(w for u in (*POS_UNITS, *DS_UNITS) for w in u)}
    return [(w, pos.get(w), ds.get(w), *of(POS_UNITS, "{}21", "{}22", w), *of(DS_UNITS, "B-{}", "I-{}", w)) for w in sorted(words)]


def _endings() -> list[tuple[str, str, int, str | None, str | None]]:
    """(the last two letters, the suffix, its length, pos, ds): each suffix of two letters or more ends with others."""
    pos, ds = dict(POS_SUFFIXES), dict(DS_SUFFIXES)
    rows = [(s[-2:], s, len(s), pos.get(s), f"B-{ds[s]}" if s in ds else None) for s in {**pos, **ds} if len(s) > 1]
    assert len({r[0] for r in rows}) == len(rows) and [s for s in {**pos, **ds} if len(s) == 1] == ["s"] and POS_SUFFIXES[-1][0] == "s"
    return rows


class RuleTagger:
    """The built-in rules: a document's tokens are exploded with their neighbours, and two tables of fixed size, of a hundred words and
    of a dozen suffixes, are joined by broadcast. The rules in generated code are few: long ones would run uncompiled for long."""

    def tag(self, corpus: DataFrame, before: bool = False) -> DataFrame:
        """Raw tokens, with before also the word before each (in lower case), which streams can't get by a window."""
        # A null text has no pieces. A filter for it here would be moved below the cleaning, and clean each text once more.
        rows = corpus.select("doc_id", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("pieces"))
        zipped = F.expr("arrays_zip(pieces, slice(pieces, 2, greatest(size(pieces), 1)), concat(array(cast(null as string)), pieces))")
        # The outer form: for the inner one the optimiser adds a filter that extracts all pieces once more.
        each = rows.select("doc_id", F.posexplode_outer(zipped).alias("tok_idx", "t")).select("doc_id", "tok_idx", F.col("t.pieces").alias("x"), F.col("t.1").alias("after"), F.col("t.2").alias("before")).where("x IS NOT NULL")
        word = lambda c: F.lower(F.rtrim(F.col(c)))
        near = each.select("doc_id", F.col("tok_idx").cast("long").alias("tok_idx"), F.rtrim("x").alias("token"), F.expr("substr(x, length(rtrim(x)) + 1)").alias("ws"), word("x").alias("w"), word("after").alias("n"), word("before").alias("p"))
        spark = corpus.sparkSession
        lexicon = spark.createDataFrame(_lexicon(), "w string, lex_pos string, lex_ds string, pos_next string, pos_first string, pos_before array<string>, pos_second string, ds_next string, ds_first string, ds_before array<string>, ds_second string")
        endings = spark.createDataFrame(_endings(), "ending string, suffix string, least int, suffix_pos string, suffix_ds string")
        tagged = near.withColumn("ending", F.substring("w", -2, 2)).join(F.broadcast(lexicon), "w", "left").join(F.broadcast(endings), "ending", "left")
        letter, digit = F.substring("w", 1, 1).between("a", "z"), F.substring("w", 1, 1).between("0", "9")
        ends = (F.length("w") > F.col("least")) & F.endswith("w", F.col("suffix"))
        unit = lambda of, else_: F.when(F.col("n") == F.col(f"{of}_next"), F.col(f"{of}_first")).when(F.array_contains(f"{of}_before", F.col("p")), F.col(f"{of}_second")).when(F.col(f"lex_{of}").isNotNull(), F.col(f"lex_{of}")).otherwise(else_)
        plural = F.when((F.length("w") > 1) & F.endswith("w", F.lit("s")), "NN2").otherwise("NN1")
        pos = F.when(digit, "MC").when(~letter, "Y").when(ends & F.col("suffix_pos").isNotNull(), F.col("suffix_pos")).otherwise(plural)
        ds = F.when(digit, "B-InformationExposition").when(ends & F.col("suffix_ds").isNotNull(), F.col("suffix_ds")).otherwise("O-")
        return tagged.select("doc_id", "tok_idx", "token", "ws", unit("pos", pos).alias("pos_tag"), unit("ds", ds).alias("ds_tag"), *([F.col("p").alias("before")] if before else []))


class FunctionTagger:
    """A trained model as a function from texts to lists of (token, ws, pos_tag, ds_tag) rows, one list a text.

    make is called once in each Python worker and returns that function, so models load where they run.
    """

    def __init__(self, make: Callable[[], Callable[[list[str]], list[list[tuple[str, str, str, str]]]]], batch: int = 25):
        self.make, self.batch = make, batch

    def tag(self, corpus: DataFrame) -> DataFrame:
        make, size = self.make, self.batch

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = make()
            for frame in frames:
                for i in range(0, len(frame), size):
                    some = frame.iloc[i : i + size]
                    rows = [(d, k, *t) for d, own in zip(some["doc_id"], model(some["text"].tolist())) for k, t in enumerate(own)]
                    yield pd.DataFrame(rows, columns=RAW_TOKENS.fieldNames())

        return corpus.where("text IS NOT NULL").select("doc_id", "text").mapInPandas(run, RAW_TOKENS)


class Pretagged:
    """Tokens that were tagged elsewhere, as a table (doc_id, tok_idx, token, ws, pos_tag, ds_tag) of the corpus's documents.

    ds_tag is IOB and label, as B-Reasoning, I-Reasoning and O-; iob and label may come apart in columns of these names, iob also
    as numbers (1 inside, 2 outside, 3 begin).
    """

    def __init__(self, tokens: DataFrame):
        if "ds_tag" not in tokens.columns and {"iob", "label"} <= set(tokens.columns):
            iob = F.col("iob").cast("string")
            mark = F.when(iob.isin("3", "B"), "B").when(iob.isin("1", "I"), "I").otherwise("O")
            tokens = tokens.withColumn("ds_tag", F.concat(mark, F.lit("-"), F.coalesce("label", F.lit(""))))
        require(tokens, RAW_TOKENS, "tagged tokens")
        self.tokens = tokens.select(*RAW_TOKENS.fieldNames())

    def tag(self, corpus: DataFrame | None = None) -> DataFrame:
        return self.tokens if corpus is None else self.tokens.join(corpus.select("doc_id"), "doc_id", "left_semi")


def checked(tagger: Tagger) -> Tagger:
    if not callable(getattr(tagger, "tag", None)):
        raise TaggerMismatch("a tagger has a method tag(corpus) that gives raw tokens")
    return tagger
