"""Corpus pipeline over ``documents``: each stage works on all that the one before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a frame; ``run`` writes what each returns to the
shared folder and reads it for the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from tallyweir.llm import bpe, decontaminate, jaccard_join, language, suffix_dedup
from tallyweir.llm.common import stored, table
from tallyweir.llm.queries import tokenizer_path


def language_id(spark, docs, sf_dir):
    """Texts without a language go: null, empty and letterless ones. Repeated rows stay each; a null ``lang`` is filled in.

    A table without labelled texts teaches no language, so nothing of it is left.
    """
    return language.keep_identified(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of similar ones stays: of five-word shingles, four fifths shared.

    It is the one of smallest doc_id; of rows that repeat its id the least by all columns. Null, empty and wordless
    texts are similar to nothing and stay, as do rows without an id.
    """
    return jaccard_join.keep_representatives(docs)


def repeated_passages(spark, docs, sf_dir):
    """Byte strings that an earlier document has go from the text, and so does a document that lost all of it.

    Null, empty and short texts stay as they are; rows of one doc_id, or without any, take nothing from each other.
    """
    return suffix_dedup.trim_repeats(docs)


def benchmark_leaks(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go; null and empty texts hold none, and without items all stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark, docs, sf_dir):
    """Token counts and digests of the texts that are left, a row for each row; a null text has no tokens."""
    return bpe.encode_report(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: The stages are beyond SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``: rows of the last one. An empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
