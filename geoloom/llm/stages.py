"""The stages of the corpus pipeline: each works on all that its predecessor kept and returns documents' columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import encode, langid, mixing, neardup, quality

MIN_LANGUAGE_SCORE = 0.5


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the base or a rule go."""
    return quality.keep(docs)


def language(spark, docs, sf_dir):
    """Documents without a recognised language go."""
    found = langid.with_language(docs, langid.fit(docs), lang_col="_lang_pred", score_col="_lang_score")
    sure = (F.col("_lang_pred") != langid.UNKNOWN) & (F.col("_lang_score") >= MIN_LANGUAGE_SCORE)
    return found.filter(sure).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates stays: that of the smallest id."""
    return neardup.keep_one(docs, percent=80)


def mixture(spark, docs, sf_dir):
    """Documents stand as often as the mix takes their words."""
    return mixing.mixed_documents(docs)


def token_ids(spark, docs, sf_dir):
    """Counts and digests of each document's ids and of what they decode to."""
    return encode.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources", mixture),
    ("byte-level BPE", token_ids),
]
