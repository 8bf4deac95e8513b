import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])

#: Names that the operators use inside.
CLASHING = "n h p a c w v k g b d t s1 s2 id pos left comp batch bucket alone size n_words n_symbols n_dup_lines n_repeat_words word_chars base_failed host host_bad _host _row _told _d _t _m _at _k _n _text _u _bin _copy _rd _rt _p _cut _start _whole _rest _edge _extra copies component_id sequence_id offset length start score rank held_out".split()

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture
def docs_of(spark):
    """documents from (doc_id, text[, lang, source]) rows, with more columns whose names the operators use inside, if `extra`."""

    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] else 0) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({name: F.lit(k) for k, name in enumerate(CLASHING)})
        return df

    return make


def counted(rows):
    return Counter(tuple(r) for r in rows)
