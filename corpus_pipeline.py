"""Cleaning, deduplicating, mixing and packing a corpus: each stage works on what the last one kept."""

import public_tokenizers

from corpuscope.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from corpuscope.llm.tables import Staged
from corpuscope.llm.training import remainder


def remove_toxic(spark, docs, sf_dir):
    """Documents below the toxicity threshold; the model is fitted on the labelled rows that op4 uses."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder(4) != 2)
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def remove_copies(spark, docs, sf_dir):
    """Of equal texts the row with the smallest doc_id."""
    return exact_dedup.deduplicate(docs)


def remove_near_copies(spark, docs, sf_dir):
    """Of linked documents the row with the smallest doc_id."""
    return jaccard_join.keep_first(docs)


def mix_sources(spark, docs, sf_dir):
    """The words that the mix takes of each document, as often as it takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark, docs, sf_dir):
    """The pieces of all documents in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", remove_toxic),
    ("exact dedup", remove_copies),
    ("n-gram Jaccard join", remove_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

# Models and tokenizers have no SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`, each written as Parquet and read again."""
    tables, docs = Staged(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = tables.write(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
