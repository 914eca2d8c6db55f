"""Registered queries of the training-data operators: thin digests over whole tables."""

from . import frames, improbable, language, matroska, maxscore, mixing, pii, quality, runlength, simhash, toxicity, turn_trie, word_bpe
from .common import table


def vocabulary():
    """The public word-level vocabulary; any file of the same form may be given instead."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity_noisy_or(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))))


@query
def op6_quality_line_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.digest(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))))


@query
def op9_poisson_mixing(spark, sf_dir):
    return mixing.poisson_mix(table(spark, sf_dir, "documents")).drop("rate")


ORACLE["op9_poisson_mixing"] = mixing.ORACLE


@query
def op2_pii_bilstm_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.digest(pii.spans(docs, pii.fit(docs)))


@query
def op3_maxscore_topk(spark, sf_dir):
    return maxscore.top_k(maxscore.integers(table(spark, sf_dir, "embeddings")))


ORACLE["op3_maxscore_topk"] = maxscore.ORACLE


@query
def op4_matroska_packets(spark, sf_dir):
    return matroska.features(matroska.media(table(spark, sf_dir, "documents")))


@query
def op7_trie_bpe(spark, sf_dir):
    return word_bpe.digest(table(spark, sf_dir, "documents"), vocabulary())


@query
def op8_simhash_gray_index(spark, sf_dir):
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


@query
def op5_language_byte_gru(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.digest(language.score(docs, language.fit(docs)))


@query
def op10_run_length_repeats(spark, sf_dir):
    return runlength.digest(runlength.remove_repeats(table(spark, sf_dir, "documents"), digest=True))


@query
def op11_seekable_fill_in_middle(spark, sf_dir):
    return frames.digest(frames.fill_in_middle(frames.stored(table(spark, sf_dir, "documents"))))


ORACLE["op11_seekable_fill_in_middle"] = frames.ORACLE


@query
def op12_improbable_features(spark, sf_dir):
    return improbable.digest(table(spark, sf_dir, "documents"))


@query
def op13_depth_band_trie(spark, sf_dir):
    return turn_trie.digest(table(spark, sf_dir, "conversations"))


ORACLE["op13_depth_band_trie"] = turn_trie.ORACLE
