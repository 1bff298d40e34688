"""The operators as queries over the driver's tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as texts
from lodestone.functions.blake3 import content_hash
from lodestone.functions.canonical import hex_of, lossy_text
from lodestone.functions.columns import shared_dir, ship, stored
from lodestone.functions.tokenizers import ByteTokenizer, VocabularyTokenizer, WhitespaceTokenizer, byte_histogram, test_vector, token_bits
from lodestone.operators import audit, loader, merkle, metadata, mixture, overlay, report, smt, views
from lodestone.operators.dedup import first_of_each, group_sizes, survivors
from lodestone.operators.mixture import Subset
from lodestone.operators.prefix import row_numbers
from lodestone.plans.predicate import compile_column, where
from lodestone.sources import readers, sinks
from lodestone.store import Corpus, Dataset, ingest
from lodestone.streaming import ingest as micro

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
VOCABULARY = os.environ.get("LODESTONE_TOKENIZER_JSON", "/opt/tokenizers/byte_bpe_50k.json")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").drop("text").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def sha(text: str = "text") -> Column:
    return F.sha2(F.col(text).cast("binary"), 256)


def unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): the first document of each content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return first_of_each(docs, sha(), "doc_id")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, token_count) of the byte view over distinct documents."""
    return unique(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("token_count"))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shard_ord, doc_id, hash) of all documents, split into four shards."""
    return table(spark, sf_dir, "documents").select(F.pmod("doc_id", F.lit(4)).cast("int").alias("shard_ord"), "doc_id", sha().alias("hash"))


LABELLED = "(SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
UNIQUE = "(SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text)"
COUNTS = f"(SELECT doc_id, octet_length(encode(text))::BIGINT AS token_count FROM {UNIQUE})"
PLACED = f"(SELECT doc_id, token_count, coalesce(sum(token_count) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS token_offset FROM {COUNTS} WHERE token_count > 0)"
BYTES = f"(SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h, generate_subscripts(regexp_extract_all(hex(encode(text)), '..'), 1) - 1 AS i FROM {UNIQUE})"


def batched(size: int) -> str:
    return f"(SELECT doc_id, batch, batch * {size} AS start, least({size}, token_count - batch * {size}) AS n, row_number() OVER (ORDER BY doc_id, batch) - 1 AS idx FROM (SELECT doc_id, token_count, unnest(range(0, (token_count + {size} - 1) // {size})) AS batch FROM {COUNTS}))"


# predicates


def _predicate(name: str, text: str, sql: str, base: str = "labelled") -> None:
    columns = {"labelled": ["doc_id", "lang", "n_chars", "quality", "toxic"], "pages": ["page_id", "url"]}[base]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = labelled(spark, sf_dir) if base == "labelled" else table(spark, sf_dir, base)
        shown = [F.coalesce(c, F.lit(-1)).alias(c) if c in ("quality", "toxic") else F.col(c) for c in columns]
        return where(df, text).select(*shown)

    run.__name__ = name
    shown = ", ".join(f"coalesce({c}, -1) AS {c}" if c in ("quality", "toxic") else c for c in columns)
    query(f"SELECT {shown} FROM {LABELLED if base == 'labelled' else base} t WHERE {sql}")(run)


_predicate("predicate_eq", "lang = 'en'", "lang IS NOT DISTINCT FROM 'en'")
_predicate("predicate_neq_null", "toxic != 1", "toxic IS DISTINCT FROM 1")
_predicate("predicate_eq_null", "toxic = NULL", "toxic IS NULL")
_predicate("predicate_compare", "n_chars >= 2000 AND quality < 1", "n_chars >= 2000 AND coalesce(quality < 1, false)")
_predicate("predicate_between", "n_chars BETWEEN 500 AND 5000", "n_chars BETWEEN 500 AND 5000")
_predicate("predicate_in", "lang IN ('de', 'fr')", "lang IN ('de', 'fr')")
_predicate("predicate_in_null", "quality IN (0, NULL)", "quality = 0 OR quality IS NULL")
_predicate("predicate_like", "url LIKE '%example.com%'", "url LIKE '%example.com%'", "pages")
_predicate("predicate_like_one", "url LIKE 'http_://%/en/%'", "url LIKE 'http_://%/en/%'", "pages")
_predicate("predicate_not", "NOT quality > 0", "NOT coalesce(quality > 0, false)")
_predicate("predicate_not_in", "NOT toxic IN (1) AND NOT lang IN ('en', 'de')", "NOT coalesce(toxic IN (1), false) AND NOT coalesce(lang IN ('en', 'de'), false)")
_predicate("predicate_not_group", "NOT (toxic = 1 OR n_chars BETWEEN 1 AND 900) AND NOT lang LIKE 'e%'", "NOT (coalesce(toxic = 1, false) OR coalesce(n_chars BETWEEN 1 AND 900, false)) AND NOT coalesce(lang LIKE 'e%', false)")
_predicate("predicate_compound", "(lang = 'en' AND n_chars BETWEEN 500 AND 5000) OR source = 'src3'", "(lang = 'en' AND n_chars BETWEEN 500 AND 5000) OR source = 'src3'")
_predicate("predicate_is_null", "quality IS NULL AND toxic IS NULL OR quality IS NOT NULL AND toxic = 1", "quality IS NULL AND toxic IS NULL OR quality IS NOT NULL AND coalesce(toxic = 1, false)")
_predicate("predicate_missing_column", "absent != 'x' AND NOT absent > 3 AND lang = 'es'", "lang = 'es'")
_predicate("predicate_typed", "lang != 1 AND quality = 1", "coalesce(quality = 1, false)")


@query(f"SELECT doc_id, coalesce(quality > 0, false) AS good FROM {LABELLED} t")
def predicate_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled(spark, sf_dir)
    return df.select("doc_id", compile_column("quality > 0", df.schema).alias("good"))


@query(f"SELECT source, count(*) AS documents, sum(n_chars)::BIGINT AS chars, count(quality) AS labelled, coalesce(sum(quality), 0)::BIGINT AS good FROM {LABELLED} t WHERE lang = 'en' AND n_chars BETWEEN 500 AND 5000 GROUP BY source")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents of medium length by source, with what is known of their quality."""
    docs = where(table(spark, sf_dir, "documents"), "lang = 'en' AND n_chars BETWEEN 500 AND 5000").select("doc_id", "source", "n_chars")
    met = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return met.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.count("quality").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("good")).orderBy("source")


# contents


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(table(spark, sf_dir, "documents"), sha(), "doc_id")


@query("SELECT copies, count(*) AS groups FROM (SELECT count(*) AS copies FROM documents GROUP BY text) GROUP BY copies")
def dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_sizes(table(spark, sf_dir, "documents"), sha())


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hex_of(content_hash(F.col("text"), "sha256")).alias("hash"))


@query()
def content_hash_blake3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hex_of(content_hash(F.col("text"))).alias("hash"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE sha256(text) = (SELECT sha256(text) FROM documents ORDER BY doc_id LIMIT 1)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    wanted = docs.orderBy("doc_id").limit(1).select(sha().alias("hash"))
    return docs.withColumn("hash", sha()).join(F.broadcast(wanted), "hash", "left_semi").select("doc_id", "lang", "n_chars")


@query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_ord, doc_id, octet_length(encode(text))::BIGINT AS content_size, text FROM {UNIQUE} t")
def corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are ingested, written, committed, opened with all checks, and read."""
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("content"), "doc_id", "lang", "source", F.col("doc_id").alias("source_ord"))
    corpus = Corpus.create(spark, f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}", docs, [ByteTokenizer()], clock=lambda: 0.0, snapshot_id="0")
    return Corpus(spark, corpus.path, "full").documents().select("doc_ord", "doc_id", "content_size", lossy_text(F.col("content")).alias("text"))


@query(f"SELECT 'byte-level-v1' AS tokenizer_id, sum(token_count)::BIGINT AS total_tokens FROM {COUNTS} t UNION ALL SELECT 'whitespace-hashed-v1', sum(len(regexp_extract_all(text, '[ \\t\\n\\r\\f\\v]+|[^ \\t\\n\\r\\f\\v]+')))::BIGINT FROM {UNIQUE} t")
def append_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("content"), F.col("doc_id").alias("source_ord"))
    corpus = Corpus.create(spark, f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}", docs, [ByteTokenizer()]).add_view(WhitespaceTokenizer())
    frames = [corpus.view(v).select(F.lit(v).alias("tokenizer_id"), "token_count") for v in corpus.views()]
    return frames[0].unionByName(frames[1]).groupBy("tokenizer_id").agg(F.sum("token_count").alias("total_tokens"))


#: Corpora that queries read, by session and folder: written once, as a corpus is.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("text").alias("content"), "doc_id", "lang", "source", "n_chars", F.col("doc_id").alias("source_ord"))


def _corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    key = (spark.sparkContext.applicationId, sf_dir, "corpus")
    if key not in _WRITTEN:
        _WRITTEN[key] = Corpus.create(spark, f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}", _source(spark, sf_dir), [ByteTokenizer()], clock=lambda: 0.0, snapshot_id="0").path
    return Corpus(spark, _WRITTEN[key], "none")


def _dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    """Two shards, of even and odd ids; the second has another view, too. Toxic documents are excluded."""
    key = (spark.sparkContext.applicationId, sf_dir, "dataset")
    if key not in _WRITTEN:
        data = Dataset.create(spark, f"{shared_dir(spark)}/dataset-{uuid.uuid4().hex}")
        for k, tokenizers in enumerate(([ByteTokenizer()], [ByteTokenizer(), WhitespaceTokenizer()])):
            Corpus.create(spark, data.shard_path(f"s{k}"), _source(spark, sf_dir).where(F.pmod("doc_id", F.lit(2)) == k), tokenizers, clock=lambda: 0.0, snapshot_id=str(k))
            data.register(f"s{k}")
        toxic = where(table(spark, sf_dir, "labels"), "toxic = 1").select("doc_id")
        hashes = table(spark, sf_dir, "documents").join(toxic, "doc_id", "left_semi").select(content_hash(F.col("text"))).distinct()
        data.exclude_all([bytes(r[0]) for r in hashes.collect()])
        _WRITTEN[key] = data.path
    return Dataset(spark, _WRITTEN[key])


_FIRST = "(SELECT * FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text))"


@query(f"SELECT doc_id, lang, n_chars FROM {_FIRST} t WHERE lang = 'en' AND n_chars >= 500 OR source = 'src3'")
def corpus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).filter("lang = 'en' AND n_chars >= 500 OR source = 'src3'").select("doc_id", "lang", "n_chars")


@query(f"SELECT doc_id, lang FROM {_FIRST} t WHERE doc_id % 3 = 0 AND (lang = 'fr' OR lang = 'de')")
def corpus_filter_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).filter(lambda row: row["doc_id"] % 3 == 0 and row["lang"] in ("fr", "de")).select("doc_id", "lang")


@query("SELECT text, true AS is_there, false AS other_is_there FROM documents ORDER BY doc_id LIMIT 1")
def corpus_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document by its hash, and whether two hashes are there."""
    corpus = _corpus(spark, sf_dir)
    wanted = bytes(table(spark, sf_dir, "documents").orderBy("doc_id").limit(1).select(content_hash(F.col("text"))).first()[0])
    return spark.createDataFrame([(corpus.get(wanted).decode(), corpus.has(wanted), corpus.has(wanted[::-1]))], "text string, is_there boolean, other_is_there boolean")


@query(f"SELECT 'documents' AS section, NULL::VARCHAR AS value, count(*) AS n FROM {_FIRST} t UNION ALL SELECT 'lang', lang, count(*) FROM {_FIRST} t WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'tokens', 'byte-level-v1', sum(octet_length(encode(text)))::BIGINT FROM {_FIRST} t")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the root, which SQL can't compute."""
    return _corpus(spark, sf_dir).summary(["lang"]).where("section != 'smt_root'")


@query(f"SELECT chunk_id, sum(least(token_offset + token_count, (chunk_id + 1) * 65536) - greatest(token_offset, chunk_id * 65536))::BIGINT AS num_tokens, 16 AS bits FROM (SELECT *, unnest(range(token_offset // 65536, (token_offset + token_count - 1) // 65536 + 1)) AS chunk_id FROM {PLACED}) GROUP BY chunk_id")
def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as they were recorded with the view; their hashes are checked when a corpus is opened in full."""
    corpus = _corpus(spark, sf_dir)
    return spark.read.parquet(f"{corpus.path}/chunks/tokenizer_id=byte-level-v1").select("chunk_id", "num_tokens", "bits")


@query(f"SELECT doc_id, text, lang, sha256(text) AS hash FROM {_FIRST} t")
def jsonl_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    sinks.to_jsonl(_corpus(spark, sf_dir).documents(), path, content="body")
    return readers.jsonl(spark, path, "body").select("doc_id", F.col("content").alias("text"), "lang", hex_of(content_hash(F.col("content"), "sha256")).alias("hash"))


@query(f"SELECT doc_id, text, source FROM {_FIRST} t")
def parquet_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    sinks.to_parquet(_corpus(spark, sf_dir).documents(), path, hashes=False)
    return readers.parquet(spark, path, "text", ["doc_id", "source"]).select("doc_id", F.col("content").alias("text"), "source")


@query(f"SELECT doc_id, text, octet_length(encode(text))::BIGINT AS n_tokens FROM {_FIRST} t")
def tokens_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their tokens, in step."""
    corpus = _corpus(spark, sf_dir)
    return sinks.table(corpus.documents(), corpus.view("byte-level-v1")).select("doc_id", "text", F.size("tokens").cast("long").alias("n_tokens"))


@query("SELECT item_id AS id, text, item_id - (SELECT min(item_id) FROM benchmark) AS place FROM benchmark")
def records_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the driver's memory as a source: the passages of the benchmark are some hundreds at any size."""
    rows = [r.asDict() for r in table(spark, sf_dir, "benchmark").orderBy("item_id").collect()]
    return readers.records(spark, rows, metadata="*").select(F.col("item_id").alias("id"), lossy_text(F.col("content")).alias("text"), F.col("source_ord").alias("place"))


_TOXIC = "(SELECT DISTINCT sha256(text) AS hash FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"
_SHARDED = f"(SELECT 's' || (doc_id % 2) AS shard_id, min(doc_id) AS doc_id, octet_length(encode(text))::BIGINT AS n, text FROM documents WHERE sha256(text) NOT IN (SELECT hash FROM {_TOXIC}) GROUP BY doc_id % 2, text)"


@query(f"SELECT shard_id, doc_id, n FROM {_SHARDED} t")
def dataset_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir).documents().select("shard_id", "doc_id", F.col("content_size").alias("n"))


@query(f"SELECT shard_id, count(*) AS batches, sum(n)::BIGINT AS tokens FROM (SELECT shard_id, unnest(range(0, (n + 1023) // 1024)) AS b, least(1024, n - b * 1024) AS n FROM {_SHARDED} WHERE n > 0) GROUP BY shard_id")
def dataset_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a view over all shards, without excluded documents."""
    return _dataset(spark, sf_dir).stream("byte-level-v1", 1024).groupBy("shard_id").agg(F.count("*").alias("batches"), F.sum(F.size("tokens")).alias("tokens"))


@query(f"SELECT shard_id, count(*) AS documents, sum(len(regexp_extract_all(text, '[ \t\n\r\f\v]+|[^ \t\n\r\f\v]+')))::BIGINT AS tokens FROM {_SHARDED} t WHERE shard_id = 's1' AND n > 0 GROUP BY 1")
def dataset_view_of_some_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards that lack the view aren't read."""
    view = _dataset(spark, sf_dir).view("whitespace-hashed-v1")
    return view.groupBy("shard_id").agg(F.count("*").alias("documents"), F.sum("token_count").alias("tokens"))


@query(f"SELECT doc_id, text FROM {UNIQUE} t")
def streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream of files; every batch is deduplicated against what is there."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "documents").schema
    micro.start(spark, f"{sf_dir}/documents.parquet*", f"{base}/documents", f"{base}/state", schema, algorithm="sha256").awaitTermination()
    return spark.read.parquet(f"{base}/documents").select("doc_id", "text")


@query("SELECT doc_id, text, lang, source FROM documents")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").repartition("doc_id").write.option("compression", "gzip").json(path)
    return readers.jsonl(spark, path, "text", "doc_id long, text string, lang string, source string").select("doc_id", F.col("content").alias("text"), "lang", "source")


@query("SELECT doc_id, text, lang FROM documents")
def parquet_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parquet(spark, f"{sf_dir}/documents.parquet", "text", ["doc_id", "lang", "absent"]).select("doc_id", F.col("content").alias("text"), "lang")


@query("SELECT text, sha256(text) AS doc_hash, lang AS meta_text, doc_id FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)")
def export_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for other libraries; a metadata column called 'text' gets another name."""
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("content"), F.col("lang").alias("text"), "doc_id", F.col("doc_id").alias("source_ord"))
    return sinks.table(ingest(docs, algorithm="sha256")).select("text", "doc_hash", "meta_text", "doc_id")


@query("SELECT doc_id, text FROM documents")
def lossy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", lossy_text(F.encode("text", "UTF-8")).alias("text"))


# tokens


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS n FROM documents")
def byte_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ByteTokenizer().count(F.col("text")).alias("n"))


@query("SELECT ('0x' || h)::INTEGER AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) GROUP BY h")
def byte_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_histogram(table(spark, sf_dir, "documents"), F.col("text"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[ \\t\\n\\r\\f\\v]+|[^ \\t\\n\\r\\f\\v]+'))::BIGINT AS n FROM documents")
def whitespace_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", WhitespaceTokenizer().count(F.col("text")).alias("n"))


@query()
def whitespace_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", WhitespaceTokenizer().tokens(F.col("text")).alias("tokens"))


@query()
def vocabulary_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = VocabularyTokenizer.from_file("byte-bpe", VOCABULARY)
    return table(spark, sf_dir, "documents").select("doc_id", tokenizer.count(F.col("text")).alias("n"))


@query("SELECT * FROM (VALUES ('byte-level-v1', 256, 16), ('whitespace-hashed-v1', 65536, 16), ('wide', 65537, 32)) t(tokenizer_id, vocab_size, bits)")
def token_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, v, token_bits(v)) for n, v in (("byte-level-v1", 256), ("whitespace-hashed-v1", 65_536), ("wide", 65_537))], "tokenizer_id string, vocab_size int, bits int")


@query(f"SELECT doc_id, token_offset, token_count FROM {PLACED} t")
def source_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.source_map(counts(spark, sf_dir), ["doc_id"]).select("doc_id", "token_offset", "token_count")


@query(f"""
    SELECT chunk_id, sum(least(token_offset + token_count, (chunk_id + 1) * 65536) - greatest(token_offset, chunk_id * 65536))::BIGINT AS num_tokens, count(*) AS num_docs
    FROM (SELECT *, unnest(range(token_offset // 65536, (token_offset + token_count - 1) // 65536 + 1)) AS chunk_id FROM {PLACED}) GROUP BY chunk_id
""")
def chunk_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.chunks(views.source_map(counts(spark, sf_dir), ["doc_id"]))


@query(f"SELECT k * 65536 AS token_offset, k AS chunk_id, 0::BIGINT AS in_chunk_offset FROM (SELECT unnest(range(0, (sum(token_count)::BIGINT + 65535) // 65536)) AS k FROM {COUNTS})")
def sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sparse_index(views.total(counts(spark, sf_dir)))


@query(f"SELECT k * 65536 AS wanted, doc_id, k * 65536 - token_offset AS in_document FROM (SELECT unnest(range(0, (sum(token_count)::BIGINT + 65535) // 65536)) AS k FROM {COUNTS}) JOIN {PLACED} p ON k * 65536 >= token_offset AND k * 65536 < token_offset + token_count")
def offset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = views.sparse_index(views.total(counts(spark, sf_dir))).select(F.col("token_offset").alias("wanted"))
    met = views.locate(wanted, views.source_map(counts(spark, sf_dir), ["doc_id"]))
    return met.select("wanted", "doc_id", (F.col("wanted") - F.col("token_offset")).alias("in_document"))


@query(f"SELECT doc_id, start, n FROM {batched(1024)} t")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.batches(counts(spark, sf_dir), 1024).select("doc_id", "start", "n")


@query(f"SELECT (token_offset + i) // 65536 AS chunk_id, count(*) AS n, sum(('0x' || h)::INTEGER)::BIGINT AS token_sum, sum((token_offset + i) % 65536 * ('0x' || h)::INTEGER)::BIGINT AS weighted FROM {BYTES} b JOIN {PLACED} p USING (doc_id) GROUP BY 1")
def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole stream of a view, position by position, summed up for each chunk."""
    docs, tokenizer = unique(spark, sf_dir), ByteTokenizer()
    placed = views.source_map(docs.select("doc_id", tokenizer.count(F.col("text")).alias("token_count")), ["doc_id"])
    return views.encoded_chunk_sums(docs.join(placed, "doc_id").select("token_offset", F.col("text").alias("content")), tokenizer)


@query(f"SELECT (idx % 4)::INTEGER AS slot, count(*) AS batches, sum(n)::BIGINT AS tokens FROM {batched(1024)} t GROUP BY 1")
def loader_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    slotted = loader.slots(counts(spark, sf_dir), ["doc_id"], 1024, 2, 2)
    return slotted.groupBy("slot").agg(F.count("*").alias("batches"), F.sum("n").alias("tokens"))


_REBATCHED = f"(SELECT slot, out_batch, least(1024, total - out_batch * 1024)::BIGINT AS n FROM (SELECT slot, total, unnest(range(0, (total + 1023) // 1024)) AS out_batch FROM (SELECT (idx % 4)::INTEGER AS slot, sum(n)::BIGINT AS total FROM {batched(1024)} GROUP BY 1)))"


@query(f"SELECT slot, out_batch, n FROM {_REBATCHED} t")
def loader_rebatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.rebatched(loader.slots(counts(spark, sf_dir), ["doc_id"], 1024, 2, 2), 1024)


@query(f"SELECT slot, out_batch, n FROM {_REBATCHED} t WHERE n = 1024")
def loader_drop_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.rebatched(loader.slots(counts(spark, sf_dir), ["doc_id"], 1024, 2, 2), 1024, drop_last=True)


@query(f"""
    SELECT (first_at + i - start) // 1024 AS out_batch, count(*) AS n, sum(('0x' || h)::INTEGER)::BIGINT AS token_sum
    FROM {BYTES} b JOIN (SELECT doc_id, start, n, coalesce(sum(n) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_at FROM {batched(1024)} WHERE idx % 2 = 1) s
      ON b.doc_id = s.doc_id AND i >= start AND i < start + n GROUP BY 1
""")
def loader_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second of two ranks is given."""
    view = unique(spark, sf_dir).select("doc_id", ByteTokenizer().tokens(F.col("text")).alias("tokens"))
    got = loader.load(view.withColumn("token_count", F.size("tokens").cast("long")), ["doc_id"], 1024, rank=1, world=2)
    sums = views.chunk_sums(got.select((F.col("out_batch") * 1024).alias("token_offset"), "tokens"), 1024)
    return sums.select(F.col("chunk_id").alias("out_batch"), "n", "token_sum")


@query()
def loader_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = unique(spark, sf_dir).select("doc_id", ByteTokenizer().tokens(F.col("text")).alias("tokens"))
    return loader.load(view.withColumn("token_count", F.size("tokens").cast("long")), ["doc_id"], 1024, rank=1, world=2, shuffle=True, epoch_seed=7)


@query(f"SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM {UNIQUE} t QUALIFY number % 6 = 3")
def doc_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.by_document(unique(spark, sf_dir).select("doc_id"), ["doc_id"], rank=1, world=3, worker=1, workers=2)


@query()
def doc_round_robin_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.by_document(unique(spark, sf_dir).select("doc_id"), ["doc_id"], rank=1, world=3, worker=1, workers=2, shuffle_seed=5)


# metadata and reports


@query("""
    SELECT 'lang' AS "column", doc_id // 256 AS zone, min(lang) AS min, max(lang) AS max, count(*) FILTER (lang IS NULL) AS null_count, list_sort(list(DISTINCT lang))[1:32]::VARCHAR AS sample FROM documents GROUP BY 2
    UNION ALL SELECT 'quality', doc_id // 256, min(quality)::VARCHAR, max(quality)::VARCHAR, count(*) FILTER (quality IS NULL), coalesce(list_sort(list(DISTINCT quality) FILTER (quality IS NOT NULL))[1:32], [])::VARCHAR FROM """ + LABELLED + " GROUP BY 2")
def zone_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = metadata.zone_stats(labelled(spark, sf_dir), "doc_id", ["lang", "quality"], 256)
    return stats.withColumn("sample", F.concat(F.lit("["), F.array_join("sample", ", "), F.lit("]")))


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def distribution_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.distribution(table(spark, sf_dir, "documents"), "lang")


@query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def distribution_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.distribution(table(spark, sf_dir, "documents"), "source")


@query("SELECT 'documents' AS section, NULL::VARCHAR AS value, count(*) AS n FROM documents UNION ALL SELECT 'lang', lang, count(*) FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(table(spark, sf_dir, "documents").select("lang", "source"), ["lang", "source"])


@query(f"SELECT count(*) AS documents, sum(octet_length(encode(text)))::BIGINT AS bytes, round(sum(octet_length(encode(text))) / count(*), 6) AS mean_bytes, sum(octet_length(encode(text)))::BIGINT AS tokens, 1.0::DOUBLE AS bytes_a_token FROM {UNIQUE} t")
def size_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = unique(spark, sf_dir)
    s = report.sizes(docs, views.total(counts(spark, sf_dir)), "text")
    return s.select("documents", "bytes", F.round("mean_bytes", 6).alias("mean_bytes"), "tokens", "bytes_a_token")


@query("SELECT source, count(*) AS documents, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(octet_length(encode(text)))::BIGINT * 1000 // sum(n_chars)::BIGINT AS bytes_a_thousand_chars FROM documents GROUP BY source")
def benchmark_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.sum(texts.content_size(F.col("text")))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), size.alias("bytes"), F.floor(size * 1000 / F.sum("n_chars")).alias("bytes_a_thousand_chars"))


@query("SELECT doc_id, quality, toxic, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 0 OR toxic = 1")
def labels_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = where(table(spark, sf_dir, "labels"), "quality = 0 OR toxic = 1")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id").select("doc_id", "quality", "toxic", "lang")


@query("SELECT doc_id AS meta_doc_hash, lang AS meta_meta_text, source AS meta_text FROM documents")
def meta_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_hash"), F.col("lang").alias("text"), F.col("source").alias("meta_text"))
    return metadata.renamed(df, ["text", "doc_hash"])


@query("""
    SELECT doc_id, count(*) AS paragraphs, sum(length(p))::BIGINT AS chars FROM (
        SELECT doc_id, regexp_replace(p, '^[\\s\\x1c-\\x1f\\x{85}\\x{a0}]+|[\\s\\x1c-\\x1f\\x{85}\\x{a0}]+$', '', 'g') AS p FROM (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10) || chr(10))) AS p FROM documents)
    ) WHERE p <> '' GROUP BY doc_id
""")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = texts.split_paragraphs(table(spark, sf_dir, "documents"))
    return parts.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("paragraph")).alias("chars"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::BIGINT AS tokens_approx, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM documents")
def approx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", texts.approximate_tokens(F.col("text")).alias("tokens_approx"), texts.line_count(F.col("text")).alias("lines"))


# mixtures

SUBSETS = [Subset("english", "lang = 'en'", 0.5), Subset("long", "n_chars > 5000", 0.3), Subset("nobody", "lang = 'xx'", 0.1), Subset("romance", "lang IN ('fr', 'es')", 0.1)]
_MEMBERS = "(SELECT 'english' AS subset, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 'long', doc_id FROM documents WHERE n_chars > 5000 UNION ALL SELECT 'romance', doc_id FROM documents WHERE lang IN ('fr', 'es'))"
DRAWS = 20_000


@query(f"SELECT subset, doc_id FROM {_MEMBERS} t")
def subset_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.members(table(spark, sf_dir, "documents"), SUBSETS, "doc_id")


@query("SELECT * FROM (VALUES ('english', 500000), ('long', 300000), ('nobody', 100000), ('romance', 100000)) t(subset, millionths)")
def subset_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, round(v * 1e6)) for k, v in mixture.weights(SUBSETS).items()], "subset string, millionths int")


@query(f"""
    WITH draws AS (SELECT k AS step, sha256(k::VARCHAR || ':42') AS h FROM range({DRAWS}) t(k)),
         chosen AS (SELECT step, ('0x' || h[1:8])::BIGINT / 4294967296.0::DOUBLE AS r, ('0x' || h[9:22])::BIGINT AS pick FROM draws),
         named AS (SELECT step, pick, CASE WHEN r <= 0.5 THEN 'english' WHEN r <= 0.8 THEN 'long' WHEN r <= 0.9 THEN 'nobody' ELSE 'romance' END AS subset FROM chosen),
         numbered AS (SELECT subset, doc_id, row_number() OVER (PARTITION BY subset ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY subset) AS n FROM {_MEMBERS})
    SELECT step, subset, doc_id FROM named JOIN numbered USING (subset) WHERE k = pick % n
""")
def mixture_sample_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.sample(table(spark, sf_dir, "documents"), SUBSETS, DRAWS, 42, order="doc_id", draw="sha256")


@query()
def mixture_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.sample(table(spark, sf_dir, "documents"), SUBSETS, DRAWS, 42, order="doc_id")


# datasets


def _excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents are on the exclusion list, by hash: their copies go too."""
    toxic = where(table(spark, sf_dir, "labels"), "toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(toxic, "doc_id", "left_semi").select(sha().alias("hash"))


_EXCLUDED = _TOXIC


@query(f"SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT hash FROM {_EXCLUDED})")
def exclusion_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", sha().alias("hash"))
    return overlay.without(docs, _excluded(spark, sf_dir), "hash").select("doc_id")


@query(f"SELECT (doc_id % 4)::INTEGER AS shard_ord, count(*) AS documents, sum(octet_length(encode(text)))::BIGINT AS tokens FROM documents WHERE sha256(text) NOT IN (SELECT hash FROM {_EXCLUDED}) GROUP BY 1")
def exclusion_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.pmod("doc_id", F.lit(4)).cast("int").alias("shard_ord"), sha().alias("hash"), F.octet_length("text").cast("long").alias("n"))
    left = overlay.without(docs, _excluded(spark, sf_dir), "hash")
    return left.groupBy("shard_ord").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"))


@query(f"SELECT hash FROM {_EXCLUDED} t UNION SELECT sha256(text) FROM benchmark")
def exclusion_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.with_exclusions(_excluded(spark, sf_dir), table(spark, sf_dir, "benchmark").select(sha().alias("hash")), "hash")


@query("SELECT 0 AS shard_ord, doc_id AS id, sha256(text) AS hash FROM documents UNION ALL SELECT 1, item_id, sha256(text) FROM benchmark")
def shard_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.lit(0).alias("shard_ord"), F.col("doc_id").alias("id"), sha().alias("hash"))
    return a.unionByName(table(spark, sf_dir, "benchmark").select(F.lit(1).alias("shard_ord"), F.col("item_id").alias("id"), sha().alias("hash")))


@query("SELECT sha256(text) AS hash, min((doc_id % 4)::INTEGER) AS shard_ord FROM documents GROUP BY text")
def shard_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_docs = shards(spark, sf_dir)
    return overlay.locate(all_docs, all_docs, "hash")


@query("SELECT (doc_id % 4)::INTEGER AS shard_ord, count(*) AS documents FROM documents WHERE doc_id % 4 IN (0, 2) GROUP BY 1")
def view_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards that lack the view aren't read: here those of even numbers have it."""
    return shards(spark, sf_dir).where(F.col("shard_ord").isin(0, 2)).groupBy("shard_ord").agg(F.count("*").alias("documents"))


_A, _B = "(SELECT DISTINCT text FROM documents WHERE doc_id % 4 < 3)", "(SELECT DISTINCT text FROM documents WHERE doc_id % 4 > 0)"


@query(f"SELECT (SELECT count(*) FROM (SELECT * FROM {_A} INTERSECT SELECT * FROM {_B})) AS shared, (SELECT count(*) FROM (SELECT * FROM {_A} EXCEPT SELECT * FROM {_B})) AS only_a, (SELECT count(*) FROM (SELECT * FROM {_B} EXCEPT SELECT * FROM {_A})) AS only_b")
def corpus_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shards(spark, sf_dir)
    return report.diff(s.where("shard_ord < 3"), s.where("shard_ord > 0"), "hash")


@query(f"SELECT * FROM (SELECT sha256(text) AS hash, 'a' AS side FROM (SELECT * FROM {_A} EXCEPT SELECT * FROM {_B}) UNION ALL SELECT sha256(text), 'b' FROM (SELECT * FROM {_B} EXCEPT SELECT * FROM {_A})) ORDER BY hash LIMIT 10")
def corpus_differing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten: the report has no more."""
    s = shards(spark, sf_dir)
    return report.differing(s.where("shard_ord < 3"), s.where("shard_ord > 0"), "hash")


@query(f"""
    SELECT hash, shard_ord, CASE WHEN NOT EXISTS (SELECT 1 FROM documents d WHERE sha256(d.text) = hash AND d.doc_id % 4 = shard_ord) THEN 'absent'
        WHEN hash IN (SELECT hash FROM {_EXCLUDED}) THEN 'present_but_excluded' ELSE 'present' END AS claim
    FROM (SELECT hash FROM {_EXCLUDED} UNION SELECT sha256(text) FROM benchmark), (SELECT unnest([0, 1, 2, 3])::INTEGER AS shard_ord)
""")
def nonmember_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = exclusion_union(spark, sf_dir)
    all_docs = shards(spark, sf_dir)
    return overlay.claims(all_docs, spark.range(4).select(F.col("id").cast("int").alias("shard_ord")), asked, _excluded(spark, sf_dir), "hash", "shard_ord")


@query(f"SELECT source, count(*) FILTER (h <= before) AS violations FROM (SELECT source, h, lag(h) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM (SELECT source, doc_id, sha256(text) AS h FROM documents)) GROUP BY source HAVING count(*) FILTER (h <= before) > 0")
def key_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the hash of a source's document isn't larger than that of the one before."""
    keys = table(spark, sf_dir, "documents").select("source", "doc_id", sha().alias("h"))
    return views.unsorted(keys, "h", ["source"], "doc_id").groupBy("source").agg(F.count("*").alias("violations"))


_SOME = f"(SELECT token_offset, token_offset + token_count AS token_end FROM {PLACED} p WHERE doc_id % 7 <> 3)"


@query(f"SELECT count(*) AS violations, 0::BIGINT AS of_the_whole FROM {_SOME} a WHERE token_offset <> 0 AND NOT EXISTS (SELECT 1 FROM {_SOME} b WHERE b.token_end = a.token_offset)")
def source_map_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps in a source map that lost rows; the whole one has none."""
    placed = stored(views.source_map(counts(spark, sf_dir), ["doc_id"]), "placed")
    broken = views.gaps(placed.where("doc_id % 7 != 3").select("token_offset", "token_count")).agg(F.count("*").alias("violations"))
    return broken.crossJoin(views.gaps(placed.select("token_offset", "token_count")).agg(F.count("*").alias("of_the_whole")))


@query(f"SELECT count(*) FILTER (largest >= 200) AS out_of_range, count(*) AS documents FROM (SELECT max(('0x' || h)::INTEGER) AS largest FROM {BYTES} b GROUP BY doc_id)")
def token_range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose tokens wouldn't fit a vocabulary of 200."""
    view = unique(spark, sf_dir).where("text != ''").select(ByteTokenizer().tokens(F.col("text")).alias("tokens"))
    return view.agg(F.count_if(~views.in_range(F.col("tokens"), 200)).alias("out_of_range"), F.count("*").alias("documents"))


# evidence


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ingestion event for each document, in logs of the twenty sources."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", sha().alias("hash"), F.octet_length("text").alias("size"))
    return docs.withColumn("payload", F.to_json(F.struct(F.col("hash").alias("doc_hash"), "size")))


@query("""
    WITH RECURSIVE e AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, sha256(doc_id::VARCHAR || ':' || sha256(text)) AS h FROM documents),
    chain AS (SELECT source, 0::BIGINT AS k, repeat('00', 32) AS root FROM (SELECT DISTINCT source FROM documents) UNION ALL SELECT e.source, e.k, sha256(unhex(chain.root || e.h)) FROM chain JOIN e ON e.source = chain.source AND e.k = chain.k + 1)
    SELECT source, max(k) AS n, arg_max(root, k) AS log_root FROM chain GROUP BY source
""")
def audit_chain_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("hash")).cast("binary"), 256)
    return audit.chain_sha256(_events(spark, sf_dir), "source", "doc_id", entry)


@query("SELECT source, count(*) AS n, 0::BIGINT AS broken FROM documents GROUP BY source")
def audit_link_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs are chained and then verified row by row."""
    numbered = row_numbers(_events(spark, sf_dir), ["source", "doc_id"], "place")
    first = numbered.groupBy("source").agg(F.min("place").alias("first"))
    events = numbered.join(F.broadcast(first), "source").select("source", (F.col("place") - F.col("first")).alias("seq"), F.lit(0.0).alias("timestamp"), F.lit("ingestion").alias("event_type"), "payload")
    log = stored(audit.chained(events, "source"), "log")
    broken = audit.broken_links(log, "source").groupBy("source").agg(F.count("*").alias("broken"))
    return log.groupBy("source").agg(F.count("*").alias("n")).join(broken, "source", "left").select("source", "n", F.coalesce("broken", F.lit(0)).cast("long").alias("broken"))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(content_hash(F.col("text")).alias("doc_hash")).distinct()


@query()
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_root_frame(_hashed(spark, sf_dir))


@query("""
    WITH RECURSIVE t AS (
        SELECT row_number() OVER (ORDER BY h) - 1 AS i, sha256(unhex('00' || h)) AS h, count(*) OVER () AS n FROM (SELECT DISTINCT sha256(text) AS h FROM documents)
        UNION ALL
        SELECT i // 2, sha256(unhex('01' || h || coalesce(after, h))), (n + 1) // 2 FROM (SELECT *, lead(h) OVER (ORDER BY i) AS after FROM t WHERE n > 1) WHERE i % 2 = 0
    ) SELECT h AS root FROM t WHERE n = 1
""")
def merkle_root_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = table(spark, sf_dir, "documents").select(content_hash(F.col("text"), "sha256").alias("doc_hash")).distinct()
    return spark.createDataFrame([(merkle.merkle_root(hashes, algorithm="sha256").hex(),)], "root string")


@query(f"""
    WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(text))::BIGINT AS size, row_number() OVER (ORDER BY doc_id) AS k FROM {UNIQUE}),
    t AS (
        SELECT k, doc_id, size, 0::BIGINT AS block, 0::BIGINT AS in_block_offset FROM d WHERE k = 1
        UNION ALL
        SELECT d.k, d.doc_id, d.size, t.block + (t.in_block_offset + t.size + 40 >= 65536)::BIGINT, CASE WHEN t.in_block_offset + t.size + 40 >= 65536 THEN 0 ELSE t.in_block_offset + t.size + 40 END FROM t JOIN d ON d.k = t.k + 1
    ) SELECT doc_id, size, block, in_block_offset FROM t
""")
def block_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct documents in blocks of bytes."""
    return views.block_layout(counts(spark, sf_dir), "doc_id", "token_count", target=65_536).drop("shard")


@query()
def smt_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(smt.smt_root(_hashed(spark, sf_dir)).hex(),)], "root string")


@query()
def smt_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of presence or absence of every passage of the benchmark, verified."""
    asked = table(spark, sf_dir, "benchmark").select(content_hash(F.col("text")).alias("doc_hash"))
    return smt.verified(smt.prove(_hashed(spark, sf_dir), asked)).select(hex_of(F.col("key")).alias("key"), "present", "verified")


@query()
def test_vector_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = unique(spark, sf_dir).select(content_hash(F.col("text")).alias("doc_hash"), F.col("text").cast("binary").alias("content"))
    v = test_vector(docs, WhitespaceTokenizer())
    return spark.createDataFrame([(v["digest"], v["doc_hashes"])], "digest string, doc_hashes array<string>")


@query()
def dataset_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shards are written and registered, benchmark passages excluded; the root before and after."""
    data = Dataset.create(spark, f"{shared_dir(spark)}/dataset-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("content"), F.col("doc_id").alias("source_ord"))
    extra = table(spark, sf_dir, "benchmark").select(F.col("text").alias("content"), F.col("item_id").alias("source_ord"))
    for name, rows in (("a", docs), ("b", extra)):
        Corpus.create(spark, data.shard_path(name), rows, clock=lambda: 0.0, snapshot_id=name)
        data.register(name)
    before = data.root().hex()
    data.exclude(bytes(data.corpus("b").documents().orderBy("doc_ord").first().doc_hash))
    return spark.createDataFrame([("before", before), ("after", data.root().hex())], "state string, root string")


@query()
def compliance_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("content"), F.col("doc_id").alias("source_ord"))
    corpus = Corpus.create(spark, f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}", docs, clock=lambda: 0.0, snapshot_id="0")
    return spark.createDataFrame([(r["type"], r["verified"]) for r in corpus.compliance(corpus.smt_root().hex())], "receipt string, verified boolean")
