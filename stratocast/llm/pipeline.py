"""The stages of ``corpus_pipeline.py``: each takes and, but for the last, returns documents.

Every stage works on all rows that its predecessor kept. Rows are dropped by the quality
model, as near-duplicates (one of each group stays, and one more if some of the group have
no doc_id) and by a drawn count of zero copies; nothing else is dropped, and rows with NULL or empty texts go through the same models.
"""

from pyspark.sql import functions as F

from ..session import written
from . import jaccard, mixing, pii, quality, word_bpe
from .common import fresh, rewrite, small_batches, table

#: The vocabulary and the models cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def keep_quality(spark, docs, sf_dir):
    """Documents whose line CRF quality reaches 0.3."""
    small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))

    def good(texts, same):
        scores = quality.document_scores([t.encode() for t in texts], model)
        return [same if s >= 0.3 else None for s in scores]

    return rewrite(docs, good, 2 << 20)


def one_of_each(spark, docs, sf_dir):
    """One row of every group of near-duplicates: that with the smallest doc_id.

    Texts link at a Jaccard similarity of 0.8 or more of their shingles of five words,
    compared in full; the SimHash index of op8 proposes pairs, MinHash those beyond its two
    bits. Groups are of rows, whatever their ids: unlike texts of one doc_id
    both stay; among alike rows of one doc_id a hash of text, language and source
    decides. Rows without doc_id are apart: one of them stays for each group.
    """
    found = jaccard.near_duplicates(docs, identity(), shingle=5, tenths=8)
    copies = found.groupBy("component", "doc_id", "row_hash").agg(F.count(F.lit(1)).alias("n"))
    kept = copies.groupBy("component", F.col("doc_id").isNull().alias("no_id")).agg(F.min(F.struct("doc_id", "row_hash", "n")).alias("k")).select("k.*")
    row_id, mark, n = (fresh(docs.columns, c) for c in ("_id", "_row", "_n"))
    kept = written(kept.toDF(row_id, mark, n), "near-kept")

    def rows(which):
        same = F.col("doc_id").cast("long").eqNullSafe(F.col(row_id)) & (identity() == F.col(mark))
        return docs.join(kept.where(which), same)

    # Only rows that occur more than once need a choice; they are rare and joined as such.
    repeated = rows(F.col(n) > 1).dropDuplicates([row_id, mark]).select(*docs.columns)
    return rows(F.col(n) == 1).select(*docs.columns).unionByName(repeated)


def identity():
    return F.xxhash64("text", "lang", "source")


def without_pii(spark, docs, sf_dir):
    """Texts with personal data replaced by <KIND>."""
    small_batches(spark)
    return pii.redact(docs, pii.fit(docs))


def mixed(spark, docs, sf_dir):
    """Sources in equal shares by Poisson replication, in random order."""
    return mixing.poisson_mix(docs).select(*docs.columns)


def tokens(spark, docs, sf_dir):
    """Token ids per row of the mixture."""
    from .queries import vocabulary
    small_batches(spark)
    return word_bpe.encode(docs, vocabulary())


STAGES = [("quality", keep_quality), ("near_duplicates", one_of_each), ("pii", without_pii), ("mixing", mixed), ("bpe", tokens)]


def run(spark, sf_dir, stages):
    docs = table(spark, sf_dir, "documents")
    for name, stage in stages:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
