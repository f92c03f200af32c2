"""One Spark query per operator, over the whole tables of a scale-factor folder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import view
from matchloom.functions import text as tx
from matchloom.functions import vectors as vx
from matchloom.operators import (
    ann,
    cache,
    chunking,
    criteria,
    demographics,
    embedding,
    impact,
    lexical,
    matching,
    quality,
    quantized,
    relational,
    retrieval,
    scale,
    similarity,
)
from matchloom.plans import analysis, cohort, load, search
from matchloom.sources import sinks, tables
from matchloom.storage import materialize, new_table_path
from matchloom.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# The default threshold asks for nearly equal names; 0.5 also lets names match that
# share one of their two words.
LOOSE = 0.5
# Text in one map of the single-object layout, about.
OBJECT_BYTES = 4 << 20
# Bytes of text in one file that byte ranges split; a file is written by one task.
SPLIT_BYTES = 1 << 27
METADATA = ("phase", "status", "enrollment", "minimum_age", "maximum_age")

_indexes: dict[tuple[str, str], str] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# --- shared inputs ---------------------------------------------------------------


def _study_chunks(spark: SparkSession, sf: str) -> DataFrame:
    studies = scale.spread(view(spark, sf, "studies"), "nct_id")
    return chunking.chunk_documents(studies, keep=METADATA)


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "studies").select(
        "nct_id", F.col("body").alias("text"), "conditions", *METADATA
    )


def _index(spark: SparkSession, sf: str) -> search.SearchIndex:
    """The stored search index of a folder, written on first use."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        path = new_table_path(spark, "search_index")
        search.write_search_index(_study_chunks(spark, sf), path)
        _indexes[key] = path
    return search.read_search_index(spark, _indexes[key], _trials(spark, sf))


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    studies = scale.spread(view(spark, sf, "studies"), "nct_id")
    return chunking.with_sections(studies.select("nct_id", "document"))


def _metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Studies with their metadata as the dynamic map of the source files."""
    pairs = []
    for name in ("phase", "status", "minimum_age", "maximum_age", "condition_1", "condition_2"):
        pairs += [F.lit(name), F.col(name)]
    for name, value in (("conditions_count", 2), ("interventions_count", 1), ("outcomes_count", 3)):
        pairs += [F.lit(name), F.lit(str(value))]
    studies = view(spark, sf, "studies")
    meta = F.create_map(*pairs, F.lit("enrollment"), F.col("enrollment").cast("string"))
    return studies.select("nct_id", "document", meta.alias("metadata"))


def _lines(df: DataFrame, items: str) -> DataFrame:
    """(nct_id, pos, text) of an array column: arrays are compared row by row."""
    return df.select("nct_id", F.posexplode(items).alias("pos", "text"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _label_centres(spark: SparkSession, sf: str) -> DataFrame:
    """Query vectors from the data: the mean direction of each label."""
    parts = view(spark, sf, "embeddings").select(
        "label", F.posexplode("embedding").alias("pos", "x")
    )
    means = parts.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"].cast("float")
    )
    return means.groupBy(F.col("label").alias("query_id")).agg(ordered.alias("embedding"))


def _criteria(spark: SparkSession, sf: str) -> DataFrame:
    """One criteria row per study: its age range and its two conditions."""
    return view(spark, sf, "studies").select(
        F.col("nct_id").alias("criteria_id"),
        F.coalesce(tx.lenient_int("minimum_age"), F.lit(0)).cast("int").alias("age_min"),
        F.coalesce(tx.lenient_int("maximum_age"), F.lit(150)).cast("int").alias("age_max"),
        tx.parse_conditions("conditions").alias("required_conditions"),
        F.lit(10).alias("limit"),
    )


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


# --- sources and sinks -----------------------------------------------------------


@query
def scan_patients(spark: SparkSession, sf: str) -> DataFrame:
    """Through the nine-column file, with every row twice and incomplete rows besides."""
    people = tables.clean_demographics(_demographics_file(spark, sf))
    return people.select("patient_id", "age", "gender", "race", "ethnicity", "name")


def _demographics_file(spark: SparkSession, sf: str) -> DataFrame:
    people = view(spark, sf, "patients").withColumns(
        {"marital": F.lit("S"), "ssn": F.lit("1"), "address": F.lit("a")}
    ).select(*tables.DEMOGRAPHICS_COLUMNS)
    path = new_table_path(spark, "demographics")
    broken = people.withColumn("name", F.lit(None).cast("string"))
    people.unionByName(people).unionByName(broken).write.parquet(path)
    return tables.load_demographics(spark, path, file_order=True)


@query
def scan_conditions(spark: SparkSession, sf: str) -> DataFrame:
    return _conditions_file(spark, view(spark, sf, "patient_conditions"))


def _conditions_file(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = new_table_path(spark, "conditions")
    rows.select(*tables.CONDITIONS_COLUMNS).write.parquet(path)
    return tables.load_conditions(spark, path)


@query
def load_all(spark: SparkSession, sf: str) -> DataFrame:
    """The three reports of a load with doubled, incomplete and orphaned rows."""
    rows = _with_gaps(spark, sf)
    orphans = rows.withColumn("patient_id", -F.col("patient_id"))
    conditions = _conditions_file(spark, rows.unionByName(rows).unionByName(orphans))
    loaded = load.load_all(_demographics_file(spark, sf), conditions, _loaded_trials(spark, sf))
    return loaded.reports


@query
def load_all_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """The condition rows that such a load keeps."""
    rows = _with_gaps(spark, sf)
    orphans = rows.withColumn("patient_id", -F.col("patient_id"))
    conditions = _conditions_file(spark, rows.unionByName(rows).unionByName(orphans))
    return load.load_all(_demographics_file(spark, sf), conditions, _loaded_trials(spark, sf)).conditions


def _loaded_trials(spark: SparkSession, sf: str) -> DataFrame:
    record = F.create_map("nct_id", F.struct("document", "metadata"))
    path = new_table_path(spark, "trials_json")
    _metadata(spark, sf).select(F.to_json(record).alias("value")).write.text(path)
    return tables.trial_table(tables.load_trials(spark, path, layout="lines"))


@query
def scan_trials_object(spark: SparkSession, sf: str) -> DataFrame:
    """One map a file, and the metadata before the document."""
    record = F.struct(F.col("nct_id").alias("key"), F.struct("metadata", "document").alias("value"))
    path = new_table_path(spark, "trials_object")
    studies = _metadata(spark, sf)
    # A map is one string: as many maps as keep each at a few MB.
    size = studies.agg(F.coalesce(F.sum(F.octet_length("document")), F.lit(0))).scalar()
    part = F.pmod(F.xxhash64("nct_id"), F.greatest(F.lit(8), F.ceil(size / F.lit(OBJECT_BYTES))))
    maps = studies.groupBy(part).agg(
        F.to_json(F.map_from_entries(F.collect_list(record))).alias("value")
    )
    maps.select("value").repartition("value").write.option("maxRecordsPerFile", 1).text(path)
    loaded = tables.trial_table(tables.load_trials(spark, path))
    return loaded.select("nct_id", "text", "conditions", "phase", "status", "enrollment")


@query
def scan_trials_split(spark: SparkSession, sf: str) -> DataFrame:
    """Maps of many records, compact and metadata first, each read in byte ranges."""
    studies = _metadata(spark, sf)
    size = studies.agg(F.coalesce(F.sum(F.octet_length("document")), F.lit(0))).scalar()
    part = F.pmod(F.xxhash64("nct_id"), F.ceil(size / F.lit(SPLIT_BYTES)) + 1).cast("int").alias("part")
    entry = F.to_json(F.create_map("nct_id", F.struct("metadata", "document")))
    studies = studies.select(part, "nct_id", entry.alias("entry"))
    last = F.broadcast(studies.groupBy("part").agg(F.max("nct_id").alias("last")))
    after = F.when(F.col("nct_id") == F.col("last"), F.lit("")).otherwise(F.lit(","))
    # The lines of a file: its opening brace, entries without their own braces, the closing one.
    entries = studies.join(last, "part").select(
        "part", F.lit(1).alias("place"), F.concat(F.expr("substr(entry, 2, length(entry) - 2)"), after).alias("value")
    )
    ends = last.select("part", F.explode(F.map_from_arrays(
        F.array(F.lit(0), F.lit(2)), F.array(F.lit("{"), F.lit("}")))).alias("place", "value"))
    path = new_table_path(spark, "trials_split")
    lines = entries.unionByName(ends).repartition("part").sortWithinPartitions("part", "place")
    lines.select("part", "value").write.partitionBy("part").text(path)
    loaded = tables.trial_table(tables.load_trials(spark, path, layout="split"))
    return loaded.select("nct_id", "text", "conditions", "phase", "status", "enrollment")


@query
def trial_table_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Enrollment written as 120.0, 120.5 and NA."""
    kind = F.col("doc_id") % 3
    text = F.col("enrollment").cast("string")
    text = F.when(kind == 0, F.concat(text, F.lit(".0"))).when(kind == 1, F.concat(text, F.lit(".5")))
    studies = view(spark, sf, "studies").select(
        "nct_id", "document",
        F.create_map(F.lit("enrollment"), F.coalesce(text, F.lit("NA"))).alias("metadata"),
    )
    return tables.trial_table(studies).select("nct_id", "enrollment")


@query
def scan_trials_json(spark: SparkSession, sf: str) -> DataFrame:
    record = F.create_map("nct_id", F.struct("document", "metadata"))
    path = new_table_path(spark, "trials_json")
    _metadata(spark, sf).select(F.to_json(record).alias("value")).write.text(path)
    loaded = tables.trial_table(tables.load_trials(spark, path, layout="lines"))
    return loaded.select("nct_id", "text", "conditions", "phase", "status", "enrollment")


@query
def sink_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    path = new_table_path(spark, "patients")
    people = view(spark, sf, "patients")
    sinks.replace_table(people, path)
    sinks.replace_table(people, path, sort_by="age")
    return spark.read.parquet(path)


@query
def sink_append(spark: SparkSession, sf: str) -> DataFrame:
    path = new_table_path(spark, "chunks")
    chunks = _index(spark, sf).chunks.select("chunk_id", "nct_id", "chunk_index", "text", "embedding")
    sinks.append_chunks(chunks.filter(F.col("chunk_index") == 0), path, buckets=8)
    sinks.append_chunks(chunks.filter(F.col("chunk_index") > 0), path, buckets=8)
    return spark.read.parquet(path).select(
        "chunk_id", "nct_id", "chunk_index", "text", F.size("embedding").alias("dim")
    )


@query
def incremental_new_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The overview chunks are stored; a run over all chunks must add just the others."""
    path = new_table_path(spark, "chunks")
    chunks = _index(spark, sf).chunks.select("chunk_id", "nct_id", "chunk_index", "text", "embedding")
    sinks.append_chunks(chunks.filter(F.col("chunk_index") == 0), path, buckets=8)
    fresh = sinks.new_chunks(chunks, sinks.stored_chunks(spark, path))
    return fresh.select("chunk_id", "nct_id", "chunk_index", "text", F.size("embedding").alias("dim"))


@query
def incremental_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All studies through the stream, then a second run that must add nothing."""
    arriving = materialize(view(spark, sf, "studies").select("nct_id", "document"), "arriving")
    folder, path = arriving.inputFiles()[0].rsplit("/", 1)[0], new_table_path(spark, "chunks")
    checkpoint = new_table_path(spark, "stream")
    for _ in range(2):
        stream = incremental.follow_documents(
            incremental.read_documents(spark, folder), path, checkpoint=checkpoint, buckets=8
        )
        stream.awaitTermination()
    return spark.read.parquet(path).drop("bucket")


# --- load-time quality -----------------------------------------------------------


def _copied_conditions(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "patient_conditions")
    return rows.unionByName(rows)


@query
def dedupe_rows(spark: SparkSession, sf: str) -> DataFrame:
    return quality.dedupe_rows(_copied_conditions(spark, sf))


@query
def pk_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "patient_conditions")
    return quality.keep_first_by_key(rows, ["patient_id"], ["id"])


def _with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Condition rows whose name is missing where the study states no enrollment."""
    rows = view(spark, sf, "patient_conditions")
    gone = F.when(F.col("id") % 9 != 0, F.col("conditions"))
    return rows.withColumn("conditions", gone)


@query
def reject_nulls(spark: SparkSession, sf: str) -> DataFrame:
    split = quality.split_nulls(_with_gaps(spark, sf), ["patient_id", "conditions"])
    good = split.good.withColumn("missing_columns", F.lit(None).cast("string"))
    return good.unionByName(split.rejected)


def _people_with_balance(spark: SparkSession, sf: str) -> DataFrame:
    customers = view(spark, sf, "customer").filter(F.col("c_acctbal") >= 0)
    return customers.select(F.col("c_custkey").alias("patient_id"))


@query
def fk_valid(spark: SparkSession, sf: str) -> DataFrame:
    return quality.split_by_parent(
        view(spark, sf, "patient_conditions"), _people_with_balance(spark, sf), "patient_id"
    ).good


@query
def fk_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return quality.split_by_parent(
        view(spark, sf, "patient_conditions"), _people_with_balance(spark, sf), "patient_id"
    ).rejected


@query
def load_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.load_report(
        "patient_conditions",
        _with_gaps(spark, sf),
        required=["patient_id", "conditions"],
        parent=_people_with_balance(spark, sf),
        parent_key="patient_id",
    )


@query
def surrogate_key(spark: SparkSession, sf: str) -> DataFrame:
    kept = fk_valid(spark, sf).withColumnRenamed("id", "place")
    return scale.dense_ids(kept, "place", "id", block_rows=1 << 12)


@query
def flatten_conditions(spark: SparkSession, sf: str) -> DataFrame:
    joined = tx.joined_numbered_fields("metadata", "condition_", "conditions_count")
    return _metadata(spark, sf).select("nct_id", joined.alias("conditions"))


@query
def project_metadata(spark: SparkSession, sf: str) -> DataFrame:
    kept = _metadata(spark, sf).select("nct_id", quality.project_metadata("metadata").alias("m"))
    return kept.select("nct_id", F.explode("m").alias("key", "value"))


@query
def sample_exact_k(spark: SparkSession, sf: str) -> DataFrame:
    studies = view(spark, sf, "studies").select("nct_id", "conditions")
    return scale.sample_exact(studies, "nct_id", 100, seed=42)


@query
def chunk_summary(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_summary(_index(spark, sf).chunks, view(spark, sf, "studies"))


# --- sections and chunks ---------------------------------------------------------


@query
def reject_empty_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Study texts, blank where no enrollment is known, split into good and empty."""
    emptied = view(spark, sf, "studies").select(
        "nct_id", F.when(F.col("enrollment").isNull(), "").otherwise(F.col("document")).alias("document")
    )
    split = chunking.split_empty_documents(emptied, "document")
    flag = "is_empty"
    return (
        split.good.withColumn(flag, F.lit(False))
        .unionByName(split.rejected.withColumn(flag, F.lit(True)))
        .select("nct_id", flag)
    )


@query
def section_title(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "studies").select(
        "nct_id", chunking.section_title("document").alias("title")
    )


@query
def extract_between(spark: SparkSession, sf: str) -> DataFrame:
    doc = "document"
    return view(spark, sf, "studies").select(
        "nct_id",
        tx.extract_between(doc, "Conditions:", "Locations:").alias("conditions"),
        tx.extract_between(doc, "Outcomes:").alias("to_end"),
        tx.extract_between(doc, "Locations:", "No such marker").alias("no_end"),
        tx.extract_between(doc, "No such marker", "Outcomes:").alias("no_start"),
    )


@query
def parse_sections(spark: SparkSession, sf: str) -> DataFrame:
    names = ("title", "inclusion", "exclusion", "conditions", "locations", "interventions")
    return _sections(spark, sf).select("nct_id", *names)


@query
def parse_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    sections = _sections(spark, sf)
    primary = _lines(sections, "primary_outcomes").withColumn("kind", F.lit("PRIMARY"))
    secondary = _lines(sections, "secondary_outcomes").withColumn("kind", F.lit("SECONDARY"))
    return primary.unionByName(secondary)


@query
def parse_outcomes_spacing(spark: SparkSession, sf: str) -> DataFrame:
    """The same outcomes with no-break spaces, all on one line."""
    text = F.concat(
        F.lit("-\u00a0PRIMARY:\u00a0"), F.element_at("primary_outcomes", 1),
        F.lit(" -\u2003SECONDARY:"), F.concat_ws("\u00a0- SECONDARY: ", "secondary_outcomes"),
    )
    lined = _sections(spark, sf).select("nct_id", text.alias("line"))
    return lined.select(
        "nct_id",
        F.array_join(chunking.split_outcomes("line", "PRIMARY"), "|").alias("primary_items"),
        F.array_join(chunking.split_outcomes("line", "SECONDARY"), "|").alias("secondary_items"),
    )


@query
def chunk_overview(spark: SparkSession, sf: str) -> DataFrame:
    parts = chunking.overview_chunks(chunking.DEFAULT_MAX_LENGTH)
    return _lines(_sections(spark, sf).select("nct_id", parts.alias("parts")), "parts")


@query
def chunk_sections(spark: SparkSession, sf: str) -> DataFrame:
    sections = _sections(spark, sf)
    parts = chunking.section_chunks("inclusion", "Inclusion Criteria", 1000)
    return _lines(sections.select("nct_id", parts.alias("parts")), "parts")


@query
def pack_words(spark: SparkSession, sf: str) -> DataFrame:
    documents = scale.spread(view(spark, sf, "documents"), "doc_id")
    return documents.select(
        "doc_id", F.posexplode(chunking.pack_words("text", 500)).alias("pos", "text")
    )


@query
def pack_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """A limit at which some titles leave room for both outcomes and some do not."""
    parts = chunking.pack_outcomes("secondary_outcomes", "Secondary Outcomes", 85)
    return _lines(_sections(spark, sf).select("nct_id", parts.alias("parts")), "parts")


@query
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _study_chunks(spark, sf).select("chunk_id", "nct_id", "chunk_index", "text")


# --- embedding and vectors -------------------------------------------------------


def _components(df: DataFrame, key: str) -> DataFrame:
    """(key, pos, x): the components that are not zero, rounded."""
    rows = df.select(key, F.posexplode_outer("embedding").alias("pos", "x"))
    return rows.filter(F.col("x") != 0).withColumn("x", F.round(F.col("x").cast("double"), 6))


@query
def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    documents = scale.spread(view(spark, sf, "documents"), "doc_id").select("doc_id", "text")
    return _components(embedding.embed_column(documents, "text"), "doc_id")


@query
def normalize_key(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit(" \n"), F.upper("conditions"), F.lit("\t "))
    return view(spark, sf, "patient_conditions").select("id", tx.normalize_key(padded).alias("key"))


@query
def embed_cached(spark: SparkSession, sf: str) -> DataFrame:
    """The vocabulary when the strings of every other patient are stored already."""
    conditions = view(spark, sf, "patient_conditions")
    stored = cache.EmbeddingCache(new_table_path(spark, "vectors"), "hash 64")
    earlier = embedding.distinct_keys(conditions.filter(F.col("patient_id") % 2 == 0), "conditions")
    cache.embed_cached(earlier, "key", stored)
    found = cache.embed_cached(embedding.distinct_keys(conditions, "conditions"), "key", stored)
    return _components(found, "key")


@query
def embed_distinct(spark: SparkSession, sf: str) -> DataFrame:
    conditions = view(spark, sf, "patient_conditions")
    return _components(embedding.embed_distinct(conditions, "conditions"), "key")


@query
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x * 3)
    unit = view(spark, sf, "embeddings").select("vec_id", vx.l2_normalize(scaled).alias("embedding"))
    return _components(unit, "vec_id")


@query
def cosine_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector with the next one."""
    vectors = view(spark, sf, "embeddings").select("vec_id", "embedding")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return vectors.join(following, "vec_id").select(
        "vec_id", vx.cosine("embedding", "next").alias("similarity")
    )


def _picky_model(most: int = 8000):
    """A stand-in model that refuses some texts, as a function that travels by value."""

    def load():
        import numpy as np

        def encode(texts):
            if any(len(t) > most for t in texts):
                raise ValueError("text too long for the model")
            return np.array([[len(t), t.count(" ")] for t in texts], dtype="float32")

        return encode

    return load


@query
def embed_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    documents = view(spark, sf, "documents").select("doc_id", "text")
    embedded = embedding.embed_column(
        documents, "text", embedder=_picky_model(), partitions=8, spread_by=["doc_id"],
        tolerate=(ValueError,),
    )
    split = embedding.split_embedded(materialize(embedded, "embedded"))
    good = split.good.select("doc_id", F.element_at("embedding", 1).cast("int").alias("length"))
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(
        split.rejected.select("doc_id", F.lit(None).cast("int").alias("length"), "error")
    )


@query
def index_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk is in the index or among the rejected, with a model that refuses long ones."""
    path = new_table_path(spark, "picky_index")
    counts = search.write_search_index(
        _study_chunks(spark, sf), path, embedder=_picky_model(1500), tolerate=(ValueError,)
    )
    good = search.read_search_index(spark, path, _trials(spark, sf)).chunks.select("chunk_id")
    bad = search.rejected_chunks(spark, path).select("chunk_id")
    return (
        good.withColumn("rejected", F.lit(False)).unionByName(bad.withColumn("rejected", F.lit(True)))
        .withColumn("counted", F.lit(counts.indexed + counts.rejected).cast("bigint"))
    )


# --- trial search ----------------------------------------------------------------


@query
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(
        similarity.top_k_by_dot(_label_centres(spark, sf), _vectors(spark, sf), 10)
    )


@query
def bm25_postings(spark: SparkSession, sf: str) -> DataFrame:
    documents = view(spark, sf, "documents").withColumnRenamed("doc_id", "chunk_id")
    return lexical.build_lexical_index(scale.spread(documents, "chunk_id")).postings


@query
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    terms = lexical.query_terms(view(spark, sf, "queries"), "query_id", "query")
    return _ranked(lexical.bm25_top_k(_index(spark, sf).lexical, terms, 10))


@query
def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    """Two rankings of the vectors, by two query vectors of each label, fused."""
    centres, vectors = _label_centres(spark, sf), _vectors(spark, sf)
    turned = centres.withColumn("embedding", F.reverse("embedding"))
    return _ranked(
        retrieval.rrf_fuse(
            similarity.top_k_by_dot(centres, vectors, 20),
            similarity.top_k_by_dot(turned, vectors, 20),
            k=20,
        )
    )


@query
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search.rank_chunks(_index(spark, sf), view(spark, sf, "queries"), k=10))


@query
def incremental_index(spark: SparkSession, sf: str) -> DataFrame:
    """Search in an index that grew twice: English studies first, then the others."""
    path, chunks = new_table_path(spark, "growing_index"), _study_chunks(spark, sf)
    search.extend_search_index(chunks.filter("phase = 'en'"), path)
    search.extend_search_index(chunks.filter("phase IN ('en', 'fr')"), path)
    search.extend_search_index(chunks, path)
    index = search.read_search_index(spark, path, _trials(spark, sf))
    return _ranked(search.rank_chunks(index, view(spark, sf, "queries"), k=10))


@query
def bm25_from_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The same answers from the stored postings, block by block, with early termination."""
    terms = lexical.query_terms(view(spark, sf, "queries"), "query_id", "query")
    return _ranked(impact.bm25_from_blocks(_index(spark, sf).lexical, terms, 10))


@query
def index_after_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Search in an index whose studies were changed and withdrawn after it was written."""
    path, chunks = new_table_path(spark, "updated_index"), _study_chunks(spark, sf)
    early = chunks.filter("phase <> 'fr'")
    outdated = early.withColumn("text", F.when(F.col("chunk_index") % 2 == 0, F.reverse("text")).otherwise(F.col("text")))
    extra = early.withColumns({c: F.concat(F.lit("gone-"), F.col(c).cast("string")) for c in ("nct_id", "chunk_id")})
    search.write_search_index(outdated.withColumn("nct_id", F.col("nct_id").cast("string")).unionByName(extra), path)
    chunks = chunks.withColumn("nct_id", F.col("nct_id").cast("string"))
    search.replace_in_index(chunks, path, withdrawn=extra.select("nct_id").distinct())
    index = search.read_search_index(spark, path, _trials(spark, sf))
    return _ranked(search.rank_chunks(index, view(spark, sf, "queries"), k=10))


@query
def filter_phase_status(spark: SparkSession, sf: str) -> DataFrame:
    keep = retrieval.phase_status_filter(phase="en", status="src5")
    return _trials(spark, sf).filter(keep).select("nct_id", "phase", "status")


@query
def filter_min_enrollment(spark: SparkSession, sf: str) -> DataFrame:
    keep = retrieval.min_enrollment_filter(1000)
    return _trials(spark, sf).filter(keep).select("nct_id", "enrollment")


@query
def best_chunk_per_trial(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector is a chunk and each label a trial: the best chunk of every trial."""
    trials = view(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").alias("nct_id")
    )
    hits = similarity.top_k_by_dot(_label_centres(spark, sf), _vectors(spark, sf), 50)
    return _ranked_trials(retrieval.best_chunk_per_trial(hits.join(trials, "chunk_id")))


def _ranked_trials(df: DataFrame) -> DataFrame:
    return df.select("query_id", "nct_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


@query
def enrich_trials(spark: SparkSession, sf: str) -> DataFrame:
    hits = lexical.bm25_top_k(
        _index(spark, sf).lexical,
        lexical.query_terms(view(spark, sf, "queries"), "query_id", "query"),
        5,
    )
    nct = F.substring_index("chunk_id", "_chunk_", 1)
    hits = materialize(hits.withColumn("nct_id", nct), "hits")
    full = retrieval.enrich_trials(hits, _trials(spark, sf), hits_bounded=scale.is_small(hits))
    return full.select("query_id", "chunk_id", "nct_id", "full_text", "conditions", "missing_trial")


def _search_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Each query with a filter of its own; NULL, '' and 0 are no filter."""
    by_three = F.col("query_id") % 3
    return view(spark, sf, "queries").select(
        "query_id",
        "query",
        F.when(by_three == 0, F.lit("en")).when(by_three == 1, F.lit("")).alias("phase"),
        F.lit(None).cast("string").alias("status"),
        F.when(by_three == 2, F.lit(1000)).otherwise(F.lit(0)).cast("bigint").alias("min_enrollment"),
    )


@query
def search_trials(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.search_trials(_index(spark, sf), _search_requests(spark, sf), top_k=5)
    return hits.select(
        "query_id",
        "nct_id",
        "chunk_id",
        F.col("rank").cast("bigint").alias("rank"),
        "chunk_similarity_score",
        "phase",
        "enrollment",
        "conditions",
        F.length("full_text").cast("bigint").alias("full_text_length"),
    )


@query
def search_trials_prefiltered(spark: SparkSession, sf: str) -> DataFrame:
    """Filters that differ between the requests: French studies, or large ones."""
    odd = F.col("query_id") % 2 == 1
    requests = view(spark, sf, "queries").withColumns(
        {"phase": F.when(~odd, F.lit("fr")), "min_enrollment": F.when(odd, F.lit(1000)).cast("bigint")}
    )
    hits = search.search_trials(_index(spark, sf), requests, top_k=5, filter_mode="pre")
    return hits.select("query_id", "nct_id", F.col("rank").cast("bigint").alias("rank"), "phase")


@query
def search_own_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Every request brings a filter that no other has, before the chunks are scored."""
    requests = view(spark, sf, "queries").withColumns(
        {
            "phase": F.when(F.col("query_id") % 3 == 0, F.lit("en")),
            "min_enrollment": (7 * F.col("query_id")).cast("bigint"),
        }
    )
    hits = search.search_trials(_index(spark, sf), requests, top_k=5, filter_mode="pre")
    return hits.select("query_id", "nct_id", F.col("rank").cast("bigint").alias("rank"), "phase", "enrollment")


@query
def search_summary(spark: SparkSession, sf: str) -> DataFrame:
    requests = _search_requests(spark, sf)
    hits = search.search_trials(_index(spark, sf), requests, top_k=5, enrich=False)
    summary = search.search_summary(requests, hits)
    return summary.select("query_id", "phase", "min_enrollment", "count")


@query
def ann_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The mean directions of the labels are the cells' centroids here."""
    stored, centroids = _celled(spark, sf)
    return _ranked(ann.ann_top_k(_label_centres(spark, sf), stored, 10, centroids, 3))


def _celled(spark: SparkSession, sf: str):
    rows = sorted(_label_centres(spark, sf).collect())  # one row per label
    centroids = np.array([r["embedding"] for r in rows], float)
    path = new_table_path(spark, "cells")
    ann.write_cells(_vectors(spark, sf), centroids, path, file_rows=500)
    return spark.read.parquet(path), centroids


@query
def ann_rows_scored(spark: SparkSession, sf: str) -> DataFrame:
    stored, centroids = _celled(spark, sf)
    return ann.rows_scored(_label_centres(spark, sf), stored, centroids, 3)


@query
def ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    stored, centroids = _celled(spark, sf)
    queries = _label_centres(spark, sf)
    exact = similarity.top_k_by_dot(queries, _vectors(spark, sf), 10)
    return ann.recall(exact, ann.ann_top_k(queries, stored, 10, centroids, 3))


def _quantized(spark: SparkSession, sf: str):
    """Index with trained cells and codebooks, and every hundredth vector as a query."""
    vectors = _vectors(spark, sf)
    quantizer = quantized.train_quantizer(vectors, 16)
    path = new_table_path(spark, "quantized")
    quantized.write_index(vectors, quantizer, path)
    index = quantized.read_index(spark, path, quantizer)
    queries = vectors.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return vectors, index, queries, quantized.choose_effort(index, 10, 0.95)


@query
def ann_quantized_topk(spark: SparkSession, sf: str) -> DataFrame:
    _, index, queries, effort = _quantized(spark, sf)
    return _ranked(quantized.top_k(queries, index, 10, effort))


@query
def ann_quantized_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of ordinary queries, and how many rows were scored with their full vectors."""
    vectors, index, queries, effort = _quantized(spark, sf)
    found = ann.recall(similarity.top_k_by_dot(queries, vectors, 10), quantized.top_k(queries, index, 10, effort))
    return found.withColumns(
        {"probes": F.lit(effort.probes), "rows_listed": F.lit(effort.listed), "rows_all": F.lit(vectors.count())}
    )


# --- patient matching ------------------------------------------------------------


@query
def age_range(spark: SparkSession, sf: str) -> DataFrame:
    people = view(spark, sf, "patients").select("patient_id", "age")
    return people.filter(matching.age_between(40, 70))


@query
def candidate_conditions(spark: SparkSession, sf: str) -> DataFrame:
    people = view(spark, sf, "patients").filter(matching.age_between(40, 70))
    return matching.candidate_conditions(view(spark, sf, "patient_conditions"), people)


@query
def group_conditions(spark: SparkSession, sf: str) -> DataFrame:
    counted = matching.count_conditions(view(spark, sf, "patient_conditions"))
    nested = matching.nest_conditions(counted)
    text = F.transform("conditions", lambda c: F.concat(c["condition"], F.lit(" x"), c["n"]))
    return nested.select("patient_id", "page", F.array_join(text, "; ").alias("conditions"))


@query
def semantic_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Required names of all studies against the condition names of all patients."""
    required = matching.requirements(_criteria(spark, sf)).select(F.col("req_key").alias("key"))
    vocabulary = embedding.embed_distinct(view(spark, sf, "patient_conditions"), "conditions")
    return matching.semantic_pairs(
        embedding.embed_column(required.distinct(), "key"), vocabulary, LOOSE
    )


@query
def match_all_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """Patients of any age meeting both conditions, for each distinct pair the studies name."""
    pairs = view(spark, sf, "studies").select(F.col("conditions").alias("criteria_id")).distinct()
    wanted = pairs.select(
        "criteria_id",
        F.lit(0).alias("age_min"),
        F.lit(200).alias("age_max"),
        tx.parse_conditions("criteria_id").alias("required_conditions"),
    )
    return matching.eligible_patients(
        view(spark, sf, "patients"), view(spark, sf, "patient_conditions"), wanted
    ).select("criteria_id", "patient_id")


@query
def match_any_condition(spark: SparkSession, sf: str) -> DataFrame:
    """Patients aged 40 to 70 with any condition of a family of names (same first word)."""
    names = view(spark, sf, "part").select("p_name").distinct()
    families = names.groupBy(F.substring_index("p_name", " ", 1).alias("criteria_id")).agg(
        F.collect_set("p_name").alias("required_conditions")
    )
    wanted = families.withColumns({"age_min": F.lit(40), "age_max": F.lit(70)})
    return matching.eligible_patients(
        view(spark, sf, "patients"),
        view(spark, sf, "patient_conditions"),
        wanted,
        require="any",
    ).select("criteria_id", "patient_id")


@query
def find_eligible_patients(spark: SparkSession, sf: str) -> DataFrame:
    hits = cohort.find_eligible_patients(
        spark,
        view(spark, sf, "patients"),
        view(spark, sf, "patient_conditions"),
        age_min=40,
        age_max=70,
        required_conditions=["hot gizmo", " ", "Small Rod"],
        threshold=LOOSE,
        limit=100,
    )
    text = F.transform("conditions", lambda c: F.concat(c["condition"], F.lit(" x"), c["n"]))
    return hits.select(
        "patient_id", "age", "gender", "race", "ethnicity", "name", "page",
        F.array_join(text, "; ").alias("conditions"),
    )


@query
def match_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    cohorts = cohort.match_cohorts(
        view(spark, sf, "patients"), view(spark, sf, "patient_conditions"), _criteria(spark, sf)
    )
    return cohorts.matched.select(
        "criteria_id", "patient_id", F.col("rank").cast("bigint").alias("rank")
    ).join(cohorts.eligible_counts, "criteria_id")


@query
def match_cohorts_by_age_only(spark: SparkSession, sf: str) -> DataFrame:
    """Studies without requirements: the first patients of the age range, and their number."""
    free = _criteria(spark, sf).withColumn("required_conditions", F.array(F.lit(" ")))
    cohorts = cohort.match_cohorts(
        view(spark, sf, "patients"), view(spark, sf, "patient_conditions"), free
    )
    return cohorts.matched.select("criteria_id", "patient_id").join(
        cohorts.eligible_counts, "criteria_id"
    )


@query
def filter_gender(spark: SparkSession, sf: str) -> DataFrame:
    wanted = _criteria(spark, sf).withColumn("gender", F.lit("F"))
    cohorts = cohort.match_cohorts(
        view(spark, sf, "patients"), view(spark, sf, "patient_conditions"), wanted
    )
    return cohorts.eligible_counts


@query
def demographics_age(spark: SparkSession, sf: str) -> DataFrame:
    return demographics.age_summary(view(spark, sf, "patients"), ["race"])


@query
def demographics_counts(spark: SparkSession, sf: str) -> DataFrame:
    return demographics.category_counts(view(spark, sf, "patients"))


@query
def demographics_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return demographics.category_counts_by_grouping_sets(view(spark, sf, "patients"))


# --- criteria and feasibility ----------------------------------------------------


@query
def parse_conditions(spark: SparkSession, sf: str) -> DataFrame:
    messy = F.concat(F.lit(" ,"), F.col("conditions"), F.lit(", ,"))
    parsed = view(spark, sf, "studies").select("nct_id", tx.parse_conditions(messy).alias("names"))
    return _lines(parsed, "names")


def _study_hits(spark: SparkSession, sf: str) -> DataFrame:
    """All studies as hits of one query per phase, ranked by document number."""
    return view(spark, sf, "studies").select(
        F.col("phase").alias("query_id"), F.col("doc_id").alias("rank"), "nct_id", "conditions",
        "minimum_age", "maximum_age", "enrollment",
    )


@query
def unique_conditions(spark: SparkSession, sf: str) -> DataFrame:
    return criteria.unique_conditions(_study_hits(spark, sf)).select(
        "query_id", F.array_join("conditions", ", ").alias("conditions")
    )


@query
def lenient_int(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "studies").select(
        "nct_id",
        tx.lenient_int("minimum_age").alias("min_age"),
        tx.lenient_int(F.concat(F.lit(" "), "maximum_age", F.lit(".9 "))).alias("max_age"),
    )


@query
def infer_criteria(spark: SparkSession, sf: str) -> DataFrame:
    inferred = criteria.infer_criteria(_study_hits(spark, sf))
    return inferred.select(
        "query_id", "n_trials", F.array_join("conditions", ", ").alias("conditions"),
        "median_min_age", "median_max_age", "median_enrollment", "patient_limit",
        "age_min", "age_max",
    )


def _feasible(spark: SparkSession, sf: str) -> DataFrame:
    """Each study's own enrollment against the number of patients in its age range."""
    free = _criteria(spark, sf).withColumn("required_conditions", F.array(F.lit(" ")))
    found = cohort.match_cohorts(
        view(spark, sf, "patients"), view(spark, sf, "patient_conditions"), free
    ).eligible_counts.withColumnRenamed("criteria_id", "nct_id")
    studies = view(spark, sf, "studies").select(
        "nct_id", F.col("enrollment").cast("double").alias("median_enrollment"), "minimum_age"
    )
    limited = studies.withColumn("patient_limit", criteria.patient_limit(F.col("median_enrollment"), 200))
    return limited.join(found, "nct_id", "left")


FEASIBILITY = [
    f"{kind}_{name}" for kind in ("capped", "population")
    for name in ("available", "ratio", "level", "risk")
]


@query
def feasibility(spark: SparkSession, sf: str) -> DataFrame:
    graded = criteria.feasibility(_feasible(spark, sf))
    return graded.select("nct_id", "target_enrollment", *FEASIBILITY)


@query
def feasibility_unknown_age(spark: SparkSession, sf: str) -> DataFrame:
    known = tx.lenient_int("minimum_age").isNotNull()
    graded = criteria.feasibility(_feasible(spark, sf), ages_known=known)
    return graded.select("nct_id", "target_enrollment", *FEASIBILITY)


@query
def analysis_summary(spark: SparkSession, sf: str) -> DataFrame:
    inferred = criteria.infer_criteria(_study_hits(spark, sf))
    sentence = criteria.summary_sentence(F.lit(7), F.lit(None).cast("string"))
    return inferred.select("query_id", sentence.alias("content"))


def _analysis(spark: SparkSession, sf: str) -> analysis.Analysis:
    return analysis.analyze_and_match(
        _index(spark, sf),
        view(spark, sf, "patients"),
        view(spark, sf, "patient_conditions"),
        view(spark, sf, "queries"),
        threshold=LOOSE,
    )


@query
def analyze_and_match(spark: SparkSession, sf: str) -> DataFrame:
    return _analysis(spark, sf).summary.select(
        "query_id", "n_trials", F.array_join("conditions", ", ").alias("conditions"),
        "median_min_age", "median_max_age", "median_enrollment", "patient_limit",
        "patients_age_min", "patients_age_max", "patients_age_median", "patients_age_mean",
        "target_enrollment", *FEASIBILITY, "content",
    )


@query
def analyze_demographics(spark: SparkSession, sf: str) -> DataFrame:
    return _analysis(spark, sf).categories


# --- relational surface ----------------------------------------------------------


@query
def lookup_patient(spark: SparkSession, sf: str) -> DataFrame:
    return relational.lookup(view(spark, sf, "patients"), "patient_id", 42)


@query
def conditions_of_patient(spark: SparkSession, sf: str) -> DataFrame:
    return relational.conditions_of(view(spark, sf, "patient_conditions"), 42)


@query
def trials_like(spark: SparkSession, sf: str) -> DataFrame:
    return relational.trials_with_condition(_trials(spark, sf), "gizmo")


@query
def patients_left_join(spark: SparkSession, sf: str) -> DataFrame:
    """All condition rows but those whose patient number was turned into no one's."""
    lost = F.when(F.col("patient_id") % 10 == 0, -F.col("patient_id")).otherwise(F.col("patient_id"))
    rows = view(spark, sf, "patient_conditions").withColumn("patient_id", lost)
    return relational.patients_with_conditions(view(spark, sf, "patients"), rows)


@query
def patient_with_conditions(spark: SparkSession, sf: str) -> DataFrame:
    return relational.patients_with_conditions(
        view(spark, sf, "patients"), view(spark, sf, "patient_conditions"), how="inner"
    )


@query
def filter_limit_offset(spark: SparkSession, sf: str) -> DataFrame:
    women = view(spark, sf, "patients").filter("gender = 'F'").select("patient_id", "name", "age")
    return relational.page(women, "patient_id", offset=10, limit=5)


@query
def trials_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The studies whose number is the number of a benchmark item."""
    ids = view(spark, sf, "benchmark").select(
        F.concat(F.lit("NCT"), F.col("item_id").cast("string")).alias("nct_id")
    )
    found = relational.by_ids(_trials(spark, sf), ids, "nct_id", ids_bounded=scale.is_small(ids))
    return found.select("nct_id", "conditions", F.length("text").cast("bigint").alias("text_length"))
