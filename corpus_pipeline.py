"""Documents to tokens: language, near copies, benchmark leaks, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's documents. All but
the last return the columns of ``documents``. Null and empty texts, repeated rows and extra columns are treated as the
operators' docstrings say; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attnstrata.llm import byte_bpe, jaccard_groups, language_crf, pii_spans, template_leaks
from attnstrata.llm.common import free_name, table
from attnstrata.session import materialize

#: A document goes if its text has no letter, or no language has this mean probability over its words.
LEAST_LANGUAGE_SCORE = 0.3
#: Near copies share this many percent of their shingles of so many words. The contract of op10 alone is 3 and 90.
SHINGLE_WORDS, SHARED_PERCENT = 5, 80
#: Text in a block of the last stage: a quarter of op3's, as executors still hold what earlier stages have touched.
BLOCK_BYTES = byte_bpe.BLOCK_BYTES // 4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found."""
    label, score = free_name(docs, "found_language"), free_name(docs, "found_score")
    found = language_crf.identify(docs, language_crf.train(docs), label, score)
    sure = (F.col(label) != language_crf.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)
    return found.where(sure).select(*docs.columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of the Jaccard join connect, that of the smallest id."""
    return jaccard_groups.keep_one(docs, width=SHINGLE_WORDS, percent=SHARED_PERCENT)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it is or with other parameters."""
    return template_leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii_spans.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of all documents."""
    return byte_bpe.op3(docs, BLOCK_BYTES)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("PII", redact_personal_data),
    ("byte-level BPE", tokenize),
]

#: The models of the first and fourth stage, and BPE, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the documents that all stages keep.

    Rows without a letter in a known language go, null and empty texts among them; of near copies the smallest id stays, of rows that
    repeat one; rows with a null id stay unless their language is not found. An empty table gives no rows; extra columns pass through
    all stages but the last.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
