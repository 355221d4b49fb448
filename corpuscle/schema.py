"""Schemas of the tables that operators take and give."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


def _of(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


S, L, D = StringType(), LongType(), DoubleType()

CORPUS = _of(doc_id=S, text=S)
RAW_TOKENS = _of(doc_id=S, tok_idx=L, token=S, ws=S, pos_tag=S, ds_tag=S)
TOKENS = _of(doc_id=S, token=S, pos_tag=S, ds_tag=S, pos_id=L, ds_id=L)
FREQUENCY = _of(Token=S, Tag=S, AF=L, RF=D, Range=D)
TAGS = _of(Tag=S, AF=L, RF=D, Range=D)
KWIC = _of(**{"Doc ID": S, "Pre-Node": S, "Node": S, "Post-Node": S})
COLLOCATIONS = _of(**{"Token": S, "Tag": S, "Freq Span": L, "Freq Total": L, "MI": D})
KEYNESS = _of(Token=S, Tag=S, LL=D, LR=D, PV=D, RF=D, RF_Ref=D, AF=L, AF_Ref=L, Range=D, Range_Ref=D)
RULER = _of(token=S, tag=S, tag_id=L)

#: Layers of tags: (tag column, id column).
LAYERS = {"pos": ("pos_tag", "pos_id"), "ds": ("ds_tag", "ds_id")}
