"""Registered queries, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockscan.functions.text import tokens
from flockscan.functions.times import to_time
from flockscan.functions.vectors import squared_l2
from flockscan.operators import accounts, collocations, graph
from flockscan.operators.centrality import betweenness_centrality, eigenvector_centrality
from flockscan.operators.communities import communities
from flockscan.operators.components import (
    component_sizes,
    connected_components,
    largest_component,
    sets_to_labels,
)
from flockscan.operators.neighbours import first_and_last, nearest_neighbours, neighbour_edges
from flockscan.operators import similarity
from flockscan.operators.skew import number_rows
from flockscan.operators.text_column import guess_text_column, length_medians
from flockscan.operators.year_slice import PARSED, parse_counts, year_slice
from flockscan.plans.coordination import coordinated_groups
from flockscan.plans.archive import slice_archive
from flockscan.sources.posts import (
    column_preview,
    fill_cores,
    nested_to_json,
    read_posts,
    write_csv,
    write_table,
    write_years,
)
from flockscan.sources.shapes import as_number, as_text, one_shape, variant_kind
from flockscan.storage import Saved, new_path, save

# The training-data operators are an optional part: without it all other queries work.
try:
    from flockscan.llm.queries import ORACLE_SQL as LLM_SQL
    from flockscan.llm.queries import QUERIES as LLM_QUERIES
except ImportError:
    LLM_QUERIES, LLM_SQL = {}, {}
try:
    import corpus_pipeline

    LLM_QUERIES = {**LLM_QUERIES, "pipeline": corpus_pipeline.run}
    if corpus_pipeline.ORACLE_SQL:
        LLM_SQL = {**LLM_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
except ImportError:
    pass

SMOKE_DIR = "/root/testdata/sf0.001"

# Parameters of the word-graph queries.
WORD_FREQ, COLOC_FREQ, STOP_WORDS = 20, 15, ("the", "de")
# Parameters of the neighbour queries: neighbours per vector, greatest squared distance.
K, NEAR = 4, 1.3
# Rounds of the eigenvector query, and edges up to which a word graph is sent to the tasks for its paths.
EIGEN_ROUNDS, SENT_EDGES = 12, 1 << 23
REFERENCE_DATE = "2024-02-15"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_cores(_table(spark, sf_dir, "documents"), "doc_id")


# Posts and times


def row_counts(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    kept = year_slice(events, 2024).agg(F.count(F.lit(1)).alias("slice_rows"))
    whole = events.agg(F.count(F.lit(1))).scalar()
    return kept.select(whole.alias("all_rows"), "slice_rows")


def year_slice_orders(spark, sf_dir):
    return year_slice(_table(spark, sf_dir, "orders"), 1997)


def year_slice_events(spark, sf_dir):
    return year_slice(_table(spark, sf_dir, "events"), 2024)


def _epoch_events(spark, sf_dir):
    """Events whose time is a number of milliseconds, missing for errors."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return _table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "error", ms).alias("created_at_ms")
    )


def epoch_ms_parse(spark, sf_dir):
    events = _epoch_events(spark, sf_dir)
    kind = events.schema["created_at_ms"].dataType
    parsed = to_time(F.col("created_at_ms"), kind)
    return events.select("event_id", parsed.cast("timestamp_ntz").alias("parsed"))


def epoch_year_slice(spark, sf_dir):
    kept = year_slice(_epoch_events(spark, sf_dir), 2024)
    return kept.withColumn(PARSED, F.col(PARSED).cast("timestamp_ntz"))


def epoch_missing_slice(spark, sf_dir):
    kept = year_slice(_epoch_events(spark, sf_dir), 1970)
    return kept.withColumn(PARSED, F.col(PARSED).cast("timestamp_ntz"))


# Layouts in which the events' times are written to be parsed again.
WRITTEN = (
    "yyyy-MM-dd HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "EEE MMM dd HH:mm:ss '+0000' yyyy",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "EEE, dd MMM yyyy HH:mm:ss 'GMT'",
    "MMM d, yyyy HH:mm:ss",
    "d MMMM yyyy HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss.SSS",
    "MM/dd/yyyy hh:mm:ss a",
)


def text_time_parse(spark, sf_dir):
    turn = F.col("event_id") % (len(WRITTEN) + 1)
    written = F.lit("no time")
    for i, layout in enumerate(WRITTEN):
        written = F.when(turn == i, F.date_format(F.date_trunc("second", "ts"), layout)).otherwise(written)
    events = _table(spark, sf_dir, "events").select("event_id", written.alias("created_at"))
    parsed = to_time(F.col("created_at"), events.schema["created_at"].dataType)
    return events.select("event_id", parsed.cast("timestamp_ntz").alias("parsed"))


def time_parse_counts(spark, sf_dir):
    return parse_counts(_table(spark, sf_dir, "events"))


def empty_slice_no_date(spark, sf_dir):
    return year_slice(_table(spark, sf_dir, "part"), 2025)


def text_column_medians(spark, sf_dir):
    parts = [
        length_medians(_table(spark, sf_dir, name)).select(
            F.lit(name).alias("table_name"),
            F.col("column").alias("column_name"),
            "median_length",
        )
        for name in ("pages", "customer", "orders")
    ]
    return one_shape(*parts)


def text_column_choice(spark, sf_dir):
    names = ("documents", "conversations", "pages", "customer", "orders")
    chosen = [(name, guess_text_column(_table(spark, sf_dir, name))) for name in names]
    return spark.createDataFrame(chosen, "table_name string, text_column string")


def mixed_batches(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("post_id"), "text", "lang"
    )
    turns = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("post_id"), "role", "text"
    )
    return one_shape(documents, turns)


def mixed_types(spark, sf_dir):
    """Two kinds of records whose fields clash in type."""
    documents = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ref"),
        F.col("text").alias("body"),
        F.col("n_chars").alias("measure"),
        F.struct("lang", "source").alias("about"),
    )
    events = _table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), "event_id").alias("ref"),
        F.col("user_id").alias("body"),
        F.col("value").alias("measure"),
        F.col("event_type").alias("about"),
    )
    mixed = save(one_shape(documents, events), "mixed").frame
    return mixed.select(
        variant_kind(F.col("ref")).alias("kind"),
        as_text(F.col("ref")).alias("ref"),
        F.length(as_text(F.col("body"))).alias("body_chars"),
        F.round(as_number(F.col("measure")), 6).alias("measure"),
        as_text(F.col("about")).alias("about"),
    )


def mixed_times(spark, sf_dir):
    """Times that are milliseconds in one batch, text in another and times in a third, then a year's slice."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    part = F.col("o_orderkey") % 3
    batches = one_shape(
        orders.filter(part == 0).select("o_orderkey", F.unix_millis("at").alias("created_at")),
        orders.filter(part == 1).select("o_orderkey", F.date_format("at", "yyyy/MM/dd").alias("created_at")),
        orders.filter(part == 2).select("o_orderkey", F.col("at").alias("created_at")),
    )
    kept = year_slice(batches, 1997)
    return kept.select("o_orderkey", F.col(PARSED).cast("timestamp_ntz").alias("parsed"))


def sliced_archive(spark, sf_dir):
    """Two years are written, one of them again with some rows changed, and both read."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    path = new_path(spark, "archive")
    write_years(orders.filter(F.year("o_orderdate").isin(1996, 1997)), path, "o_orderdate")
    again = year_slice(orders.withColumn("o_totalprice", F.lit(0.0)), 1997).drop(PARSED)
    write_years(again.filter("o_orderkey > 100"), path, "o_orderdate")
    return read_posts(spark, path)


def nested_cells_to_json(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    return nested_to_json(
        orders.select(
            "o_orderkey",
            F.struct("o_custkey", F.nullif("o_orderstatus", F.lit("F")).alias("status")).alias("details"),
            F.array("o_orderstatus", "o_orderpriority").alias("tags"),
            F.create_map("o_orderstatus", "o_custkey").alias("by_status"),
        )
    )


def csv_round_trip(spark, sf_dir):
    """Whole texts, outer blanks, and empty cells beside missing ones."""
    gap = F.when(F.col("lang") == "en", "").when(F.col("lang") != "fr", F.col("lang"))
    kept = _table(spark, sf_dir, "documents").select(
        "*",
        F.concat(F.lit("  "), "lang", F.lit(" ")).alias("padded"),
        gap.alias("gap"),
        F.array("doc_id").alias("ids"),
    )
    path = new_path(spark, "csv")
    write_csv(kept, path)
    return read_posts(spark, path, "csv", nested_to_json(kept).schema)


def table_round_trip(spark, sf_dir):
    kept = year_slice(_table(spark, sf_dir, "events"), 2024)
    name = f"posts_{uuid.uuid4().hex}"
    write_table(kept, name, new_path(spark, "tweets"))
    return spark.table(name)


def parquet_archive(spark, sf_dir):
    return read_posts(spark, f"{sf_dir}/documents.parquet")


def json_archive(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    path = new_path(spark, "json")
    documents.write.json(path)
    return read_posts(spark, path, "json", documents.schema)


def archive_slice(spark, sf_dir):
    """One year of an archive with its text column, and what both sinks hold of it."""
    path, name = new_path(spark, "csv"), f"posts_{uuid.uuid4().hex}"
    made = slice_archive(_table(spark, sf_dir, "events"), 2024, path, name, new_path(spark, "tweets"))
    schema = nested_to_json(made.posts).schema
    written = read_posts(spark, path, "csv", schema).agg(F.count(F.lit(1)).alias("csv_rows"))
    stored = spark.table(name).agg(F.count(F.lit(1))).scalar()
    return written.select(
        F.lit(made.rows).cast("long").alias("slice_rows"),
        F.lit(made.text_column).alias("text_column"),
        "csv_rows",
        stored.alias("table_rows"),
    )


def previewed_columns(spark, sf_dir):
    """How many values the columns of a preview hold."""
    orders = _table(spark, sf_dir, "orders")
    counts = orders.agg(*(F.count(c).alias(c) for c in column_preview(orders)))
    return counts.unpivot([], counts.columns, "column_name", "filled")


# Words and word graphs


def token_counts(spark, sf_dir):
    found = tokens(F.col("text"))
    return _documents(spark, sf_dir).select(
        "doc_id",
        F.size(found).alias("tokens"),
        F.size(F.array_distinct(found)).alias("distinct_words"),
    )


def word_sizes(spark, sf_dir):
    return collocations.word_sizes(_documents(spark, sf_dir))


def doc_frequency(spark, sf_dir):
    return collocations.doc_frequency(_documents(spark, sf_dir))


def vocabulary(spark, sf_dir):
    return collocations.vocabulary(_documents(spark, sf_dir), WORD_FREQ, STOP_WORDS)


def bigram_edges(spark, sf_dir):
    words = collocations.ordered_words(_documents(spark, sf_dir), WORD_FREQ, STOP_WORDS)
    edges = collocations.weighted(collocations.pair_counts(words, COLOC_FREQ))
    return edges.withColumn("weight", F.round("weight", 12))


def bigram_edges_shuffled(spark, sf_dir):
    """The way taken by vocabularies too large to broadcast."""
    words = collocations.ordered_words(
        _documents(spark, sf_dir), WORD_FREQ, STOP_WORDS, broadcast_bytes=-1
    )
    edges = collocations.weighted(collocations.pair_counts(words, COLOC_FREQ))
    return edges.withColumn("weight", F.round("weight", 12))


def bigram_edges_all(spark, sf_dir):
    words = collocations.ordered_words(_documents(spark, sf_dir))
    edges = collocations.weighted(collocations.pair_counts(words))
    return edges.withColumn("weight", F.round("weight", 12))


def bigram_edges_mixed(spark, sf_dir):
    """Rows of two tables, whose ids repeat and need not be there."""
    rows = mixed_batches(spark, sf_dir).withColumn("post_id", F.nullif("post_id", F.lit(1)))
    words = collocations.ordered_words(rows, WORD_FREQ, STOP_WORDS, doc_id="post_id")
    return collocations.pair_counts(words, COLOC_FREQ)


def ranked_edges(spark, sf_dir):
    """Every edge with its place in the order of the edge list."""
    edges = _word_edges(spark, sf_dir).frame
    order = [F.desc("weight"), F.asc("source"), F.asc("target")]
    placed = number_rows(edges, order, "position")
    return placed.withColumn("weight", F.round("weight", 12))


def _word_graph(spark, sf_dir):
    return collocations.collocations(
        _documents(spark, sf_dir), WORD_FREQ, COLOC_FREQ, STOP_WORDS
    )


def _word_edges(spark, sf_dir) -> Saved:
    return save(_word_graph(spark, sf_dir)[0], "word-edges")


def collocation_nodes(spark, sf_dir):
    return _word_graph(spark, sf_dir)[1]


def graph_stats(spark, sf_dir):
    edges, nodes = _word_graph(spark, sf_dir)
    stats = graph.graph_stats(edges, nodes)
    return stats.withColumn("density", F.round("density", 12))


def first_nodes(spark, sf_dir):
    """The head of the node table, a look at five words."""
    return collocations.first_nodes(_word_graph(spark, sf_dir)[1])


def degree(spark, sf_dir):
    edges, nodes = _word_graph(spark, sf_dir)
    return graph.degrees(edges, nodes)


def nodes_with_degree(spark, sf_dir):
    edges, nodes = _word_graph(spark, sf_dir)
    return graph.with_attribute(nodes, graph.degrees(edges))


def word_components(spark, sf_dir):
    edges = _word_edges(spark, sf_dir).frame
    return connected_components(edges)


def word_communities(spark, sf_dir):
    return communities(_word_edges(spark, sf_dir).frame)


def word_communities_modularity(spark, sf_dir):
    edges = _word_edges(spark, sf_dir)
    labels = communities(edges.frame).withColumnRenamed("modularity", "label")
    return graph.modularity(edges.frame, labels, edge_rows=edges.rows)


def word_eigenvector(spark, sf_dir):
    edges = _word_edges(spark, sf_dir).frame
    found = eigenvector_centrality(edges, tolerance=None, max_rounds=EIGEN_ROUNDS)
    return found.withColumn("eigenvector", F.round("eigenvector", 9))


def word_betweenness(spark, sf_dir):
    """Over all shortest paths between all words of the graph."""
    edges, nodes = _word_graph(spark, sf_dir)
    edges, nodes = save(edges, "word-edges").frame, save(nodes, "word-nodes").frame
    found = betweenness_centrality(edges, nodes, sent_edges=SENT_EDGES)
    return found.withColumn("betweenness", F.round("betweenness", 9))


# Neighbours


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("dist2", F.round("dist2", 6))


def vector_count(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").agg(F.count("embedding").alias("vectors"))


def knn_exact(spark, sf_dir):
    return _rounded(nearest_neighbours(_table(spark, sf_dir, "embeddings"), k=K))


def knn_blocks(spark, sf_dir):
    """The way taken by a base too large to broadcast."""
    vectors = _table(spark, sf_dir, "embeddings")
    return _rounded(nearest_neighbours(vectors, k=K, broadcast_bytes=0, block_rows=128))


def knn_with_gaps(spark, sf_dir):
    """Some vectors are missing as a whole."""
    vectors = _table(spark, sf_dir, "embeddings")
    return _rounded(nearest_neighbours(vectors.withColumn("embedding", F.expr("if(label = 3, NULL, embedding)")), k=K))


def knn_others(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return _rounded(nearest_neighbours(vectors, k=K, exclude_self=True))


def knn_subset(spark, sf_dir):
    """A look at the first five vectors, a check on the base rather than a full search."""
    vectors = _table(spark, sf_dir, "embeddings")
    first = vectors.orderBy("vec_id").limit(5)
    return _rounded(nearest_neighbours(first, vectors, k=K))


def knn_head_tail(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return _rounded(nearest_neighbours(first_and_last(vectors), vectors, k=K))


def neighbour_distances(spark, sf_dir):
    """The distances again, from the two vectors by column functions."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = nearest_neighbours(vectors, k=K, exclude_self=True)
    left = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("a"))
    right = vectors.select(F.col("vec_id").alias("neighbour_id"), F.col("embedding").alias("b"))
    both = found.select("query_id", "neighbour_id").join(left, "query_id").join(right, "neighbour_id")
    return both.select(
        "query_id", "neighbour_id", F.round(squared_l2(F.col("a"), F.col("b")), 6).alias("dist2")
    )


def pairs_within(spark, sf_dir):
    """Close ones among the nearest few."""
    found = nearest_neighbours(_table(spark, sf_dir, "embeddings"), k=K, exclude_self=True)
    return neighbour_edges(found, NEAR).select("source", "target")


def pairs_within_all(spark, sf_dir):
    """All close pairs, however many a vector has."""
    return _rounded(similarity.pairs_within(_table(spark, sf_dir, "embeddings"), NEAR))


def _rounded_similarity(found: DataFrame) -> DataFrame:
    return found.withColumn("similarity", F.round("similarity", 6))


def knn_inner_product(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return _rounded_similarity(similarity.most_similar(vectors, k=K, exclude_self=True))


def knn_cosine(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return _rounded_similarity(similarity.most_similar(vectors, k=K, measure="cosine", exclude_self=True))


def undirected_edges(spark, sf_dir):
    """Neighbours both ways as one edge; the heavier weight is kept."""
    vectors = _table(spark, sf_dir, "embeddings")
    found = nearest_neighbours(vectors, k=K, exclude_self=True)
    ways = found.select(
        F.col("query_id").alias("source"),
        F.col("neighbour_id").alias("target"),
        (F.lit(1.0) / F.col("rank")).alias("weight"),
    )
    edges = graph.undirected(ways)
    return edges.withColumn("weight", F.round("weight", 12))


def undirected_last(spark, sf_dir):
    """Neighbours both ways as one edge; the one of the larger query counts."""
    vectors = _table(spark, sf_dir, "embeddings")
    found = nearest_neighbours(vectors, k=K, exclude_self=True)
    ways = found.select(
        F.col("query_id").alias("source"),
        F.col("neighbour_id").alias("target"),
        F.col("rank").cast("double").alias("weight"),
        F.col("query_id").alias("at"),
    )
    return graph.undirected(ways, order="at")


def _nearest_graph(spark, sf_dir) -> tuple[Saved, DataFrame]:
    """Each vector linked with the nearest other one."""
    vectors = _table(spark, sf_dir, "embeddings")
    found = nearest_neighbours(vectors, k=1, exclude_self=True)
    nodes = vectors.select(F.col("vec_id").alias("id"))
    return save(neighbour_edges(found), "nearest"), nodes


def nearest_betweenness(spark, sf_dir):
    """Over all shortest paths."""
    edges, nodes = _nearest_graph(spark, sf_dir)
    found = betweenness_centrality(edges.frame, nodes, normalized=False)
    return found.withColumn("betweenness", F.round("betweenness", 9))


def components(spark, sf_dir):
    edges, nodes = _nearest_graph(spark, sf_dir)
    return connected_components(edges.frame, nodes)


def component_sets(spark, sf_dir):
    """Components as sets of members, and back to a label for each member."""
    labelled = components(spark, sf_dir)
    sets = labelled.groupBy(F.col("component").alias("index")).agg(F.collect_set("id").alias("members"))
    return sets_to_labels(sets)


def communities_check(spark, sf_dir):
    """What holds of any community labelling, on the graph of nearest vectors."""
    vectors = _table(spark, sf_dir, "embeddings")
    found = nearest_neighbours(vectors, k=K, exclude_self=True)
    edges = save(neighbour_edges(found), "near")
    nodes = vectors.select(F.col("vec_id").alias("id"))
    labels = save(communities(edges.frame, nodes, name="label"), "labels").frame
    parts = save(connected_components(edges.frame, nodes), "parts").frame
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    next_size = sizes.select((F.col("label") - 1).alias("label"), F.col("n").alias("next"))
    spans = labels.join(parts, "id").groupBy("label").agg(F.count_distinct("component").alias("parts"))
    by_part = parts.withColumnRenamed("component", "label")
    return labels.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("id").alias("distinct_nodes")).select(
        "nodes",
        (F.col("nodes") == F.col("distinct_nodes")).alias("each_once"),
        (spans.agg(F.max("parts")).scalar() == 1).alias("within_components"),
        sizes.join(next_size, "label").agg(F.min(F.col("n") >= F.col("next"))).scalar().alias("by_falling_size"),
        (
            graph.modularity(edges.frame, labels, edge_rows=edges.rows).scalar()
            >= graph.modularity(edges.frame, by_part, edge_rows=edges.rows).scalar()
        ).alias("no_worse_than_components"),
    )


def sizes_of_components(spark, sf_dir):
    edges, nodes = _nearest_graph(spark, sf_dir)
    return component_sizes(connected_components(edges.frame, nodes))


def largest_subgraph(spark, sf_dir):
    edges, nodes = _nearest_graph(spark, sf_dir)
    labelled = connected_components(edges.frame, nodes)
    _, inside = largest_component(edges.frame, labelled, edge_rows=edges.rows)
    return inside.select("source", "target")


def label_modularity(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    found = nearest_neighbours(vectors, k=K, exclude_self=True)
    edges = save(neighbour_edges(found), "near")
    labels = vectors.select(F.col("vec_id").alias("id"), "label")
    q = graph.modularity(edges.frame, labels, edge_rows=edges.rows)
    return q.select(F.round("modularity", 9).alias("modularity"))


def groups_of_close_vectors(spark, sf_dir):
    return coordinated_groups(_table(spark, sf_dir, "embeddings"), NEAR)


# Accounts


def _profile(spark, sf_dir):
    """Events as posts of customers; an account starts with its first event."""
    events = _table(spark, sf_dir, "events")
    posts = events.select(
        F.col("user_id").cast("string").alias("screen_name"),
        F.floor("value").alias("engagements"),
    )
    life = events.groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.min("ts").alias("created_at"), F.count(F.lit(1)).alias("lifetime_posts")
    )
    people = _table(spark, sf_dir, "customer").join(life, "c_custkey")
    holders = people.select(
        F.col("c_custkey").cast("string").alias("screen_name"),
        "created_at",
        "lifetime_posts",
        F.col("c_acctbal").alias("followers"),
        F.col("c_nationkey").alias("following"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("description"),
    )
    profile = accounts.account_profile(posts, holders, F.lit(REFERENCE_DATE).cast("date"))
    for name in ("posts_per_day", "followers_following_ratio", "avg_engagements_per_post"):
        profile = profile.withColumn(name, F.round(name, 9))
    return profile


def account_profile(spark, sf_dir):
    return _profile(spark, sf_dir)


def top_accounts(spark, sf_dir):
    young = accounts.suspects(_profile(spark, sf_dir), max_age_days=46, min_posts_per_day=0.1)
    return accounts.top_accounts(young)


def report_round_trip(spark, sf_dir):
    report = top_accounts(spark, sf_dir)
    path = new_path(spark, "report")
    accounts.write_report(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


def entry(spark: SparkSession) -> DataFrame:
    """Weighted word pairs of the smoke-test documents."""
    words = collocations.ordered_words(_documents(spark, SMOKE_DIR))
    return collocations.weighted(collocations.pair_counts(words, 2))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        **LLM_QUERIES,
        "row_counts": row_counts,
        "year_slice_orders": year_slice_orders,
        "year_slice_events": year_slice_events,
        "epoch_ms_parse": epoch_ms_parse,
        "epoch_year_slice": epoch_year_slice,
        "epoch_missing_slice": epoch_missing_slice,
        "text_time_parse": text_time_parse,
        "time_parse_counts": time_parse_counts,
        "empty_slice_no_date": empty_slice_no_date,
        "text_column_medians": text_column_medians,
        "text_column_choice": text_column_choice,
        "mixed_batches": mixed_batches,
        "mixed_types": mixed_types,
        "mixed_times": mixed_times,
        "sliced_archive": sliced_archive,
        "nested_to_json": nested_cells_to_json,
        "csv_round_trip": csv_round_trip,
        "table_round_trip": table_round_trip,
        "parquet_archive": parquet_archive,
        "json_archive": json_archive,
        "archive_slice": archive_slice,
        "previewed_columns": previewed_columns,
        "token_counts": token_counts,
        "word_sizes": word_sizes,
        "doc_frequency": doc_frequency,
        "vocabulary": vocabulary,
        "bigram_edges": bigram_edges,
        "bigram_edges_shuffled": bigram_edges_shuffled,
        "bigram_edges_all": bigram_edges_all,
        "bigram_edges_mixed": bigram_edges_mixed,
        "ranked_edges": ranked_edges,
        "collocation_nodes": collocation_nodes,
        "graph_stats": graph_stats,
        "first_nodes": first_nodes,
        "degree": degree,
        "nodes_with_degree": nodes_with_degree,
        "word_components": word_components,
        "communities": word_communities,
        "communities_modularity": word_communities_modularity,
        "vector_count": vector_count,
        "knn_exact": knn_exact,
        "knn_blocks": knn_blocks,
        "knn_with_gaps": knn_with_gaps,
        "knn_others": knn_others,
        "knn_subset": knn_subset,
        "knn_head_tail": knn_head_tail,
        "neighbour_distances": neighbour_distances,
        "word_eigenvector": word_eigenvector,
        "word_betweenness": word_betweenness,
        "nearest_betweenness": nearest_betweenness,
        "pairs_within": pairs_within,
        "pairs_within_all": pairs_within_all,
        "knn_inner_product": knn_inner_product,
        "knn_cosine": knn_cosine,
        "undirected_edges": undirected_edges,
        "undirected_last": undirected_last,
        "components": components,
        "component_sets": component_sets,
        "communities_check": communities_check,
        "component_sizes": sizes_of_components,
        "largest_subgraph": largest_subgraph,
        "label_modularity": label_modularity,
        "coordinated_groups": groups_of_close_vectors,
        "account_profile": account_profile,
        "top_accounts": top_accounts,
        "report_round_trip": report_round_trip,
    }


# SQL


def _words_sql() -> str:
    """Tokens, document frequencies and surviving words of every document."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
    tokens AS (
        SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS word FROM documents
    ),
    kept AS (SELECT doc_id, word FROM tokens WHERE word NOT IN ({stops})),
    vocabulary AS (
        SELECT word, count(*) AS size FROM kept
        GROUP BY word HAVING count(DISTINCT doc_id) >= {WORD_FREQ}
    )"""


def _pairs_sql() -> str:
    return f"""{_words_sql()},
    own AS (SELECT DISTINCT doc_id, word FROM kept SEMI JOIN vocabulary USING (word)),
    following AS (
        SELECT word AS source, lead(word) OVER (PARTITION BY doc_id ORDER BY word) AS target FROM own
    ),
    pairs AS (
        SELECT source, target, count(*) AS freq FROM following WHERE target IS NOT NULL
        GROUP BY source, target HAVING count(*) >= {COLOC_FREQ}
    ),
    ends AS (SELECT source AS word FROM pairs UNION SELECT target FROM pairs)"""


EDGES_SQL = "freq, round(freq / (SELECT sum(freq) FROM pairs), 12)"


def _near_sql(k: int, include_self: bool = False) -> str:
    return f"""
    vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    gaps AS (
        SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, list_distance(a.v, b.v) ** 2 AS dist2
        FROM vectors a, vectors b {"" if include_self else "WHERE a.vec_id <> b.vec_id"}
    ),
    ranked AS (
        SELECT query_id, neighbour_id, dist2,
            CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist2, neighbour_id) AS INTEGER) AS rank
        FROM gaps
    ),
    near AS (SELECT * FROM ranked WHERE rank <= {k}),
    links AS (
        SELECT DISTINCT least(query_id, neighbour_id) AS source,
            greatest(query_id, neighbour_id) AS target
        FROM near
    )"""


def _within_sql() -> str:
    """Pairs between the first of equal vectors, and these with their copies."""
    return f"""
    classes AS (SELECT min(vec_id) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings GROUP BY embedding),
    within AS (
        SELECT a.id AS source, b.id AS target, list_distance(a.v, b.v) ** 2 AS dist2
        FROM classes a, classes b WHERE a.id < b.id AND list_distance(a.v, b.v) ** 2 <= {NEAR}
        UNION ALL
        SELECT id, vec_id, 0.0::DOUBLE FROM embeddings JOIN classes ON v = CAST(embedding AS DOUBLE[]) WHERE id <> vec_id
    )"""


def _similar_sql(measure: str) -> str:
    return f"""
        WITH vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        ranked AS (
            SELECT query_id, neighbour_id, round(similarity, 6) AS similarity,
                CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id) AS INTEGER) AS rank
            FROM (
                SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, {measure}(a.v, b.v) AS similarity
                FROM vectors a, vectors b WHERE a.vec_id <> b.vec_id
            )
        )
        SELECT * FROM ranked WHERE rank <= {K}"""


def _components_sql(nodes: str, edges: str) -> str:
    """``labelled(id, component)`` of the named node and edge tables."""
    return f"""
    ways AS (SELECT source AS a, target AS b FROM {edges} UNION SELECT target, source FROM {edges}),
    reached(id, other) AS (
        SELECT id, id FROM {nodes} UNION SELECT r.id, w.b FROM reached r JOIN ways w ON r.other = w.a
    ),
    rooted AS (SELECT id, min(other) AS root FROM reached GROUP BY id),
    sized AS (SELECT root, count(*) AS size FROM rooted GROUP BY root),
    numbered AS (
        SELECT root, size, row_number() OVER (ORDER BY size DESC, root) - 1 AS component FROM sized
    ),
    labelled AS (SELECT id, component FROM rooted JOIN numbered USING (root))"""


# No shortest path of the test graphs has so many edges.
DEPTH = 64
# Pairs of other nodes.
_PAIR_SCALE = """(SELECT 1 / ((count(*) - 1) * (count(*) - 2)) FROM nodes)"""


def _betweenness_sql(nodes: str, edges: str, sources: str, scale: str) -> str:
    """Walks from each source, of which those of least length are its shortest paths; then back."""
    return f"""
    hops AS (SELECT source AS id, target AS other FROM {edges} UNION SELECT target, source FROM {edges}),
    walks(s, id, level, n) AS (
        SELECT id, id, 0, 1.0::DOUBLE FROM {sources}
        UNION ALL
        SELECT s, other, level + 1, sum(n) FROM walks JOIN hops USING (id) WHERE level < {DEPTH}
        GROUP BY s, other, level
    ),
    paths AS (SELECT s, id, min(level) AS level, arg_min(n, level) AS n FROM walks GROUP BY s, id),
    back(s, id, level, n, part) AS (
        SELECT s, id, level, n, 0.0::DOUBLE FROM paths WHERE level = (SELECT max(level) FROM paths)
        UNION ALL
        SELECT p.s, p.id, p.level, any_value(p.n), coalesce(sum(p.n / c.n * (1 + c.part)), 0)
        FROM (SELECT max(level) - 1 AS level FROM back) AS turn JOIN paths p ON p.level = turn.level
            LEFT JOIN (
                SELECT b.s, w.id, b.n, b.part FROM back b JOIN hops w ON w.other = b.id
            ) c ON c.s = p.s AND c.id = p.id
        GROUP BY p.s, p.id, p.level
    ),
    through AS (SELECT id, sum(part) AS part FROM back WHERE level > 0 GROUP BY id)
    SELECT id, round(coalesce(part, 0) * {scale}, 9) AS betweenness FROM {nodes} LEFT JOIN through USING (id)"""


PROFILE_SQL = f"""
    life AS (
        SELECT user_id, count(*) AS posts, min(ts) AS created_at,
            CAST(sum(floor(value)) AS BIGINT) AS engagements
        FROM events GROUP BY user_id
    ),
    profile AS (
        SELECT CAST(user_id AS VARCHAR) AS account_screen_name,
            CAST(date_diff('day', CAST(created_at AS DATE), DATE '{REFERENCE_DATE}') AS INTEGER)
                AS account_age_days,
            posts AS nb_posts_in_dataset,
            round(posts / nullif(date_diff('day', CAST(created_at AS DATE), DATE '{REFERENCE_DATE}'), 0), 9)
                AS posts_per_day,
            c_acctbal AS account_followers,
            round(c_acctbal / nullif(c_nationkey, 0), 9) AS followers_following_ratio,
            c_mktsegment = 'BUILDING' AS has_no_description,
            round(engagements / posts, 9) AS avg_engagements_per_post
        FROM life JOIN customer ON user_id = c_custkey
    )"""


def oracle_sql() -> dict[str, str]:
    epoch = """
        SELECT event_id, CASE WHEN event_type <> 'error' THEN epoch_us(ts) // 1000 END AS created_at_ms
        FROM events"""
    nearest = f"{_near_sql(1)}, nodes AS (SELECT vec_id AS id FROM embeddings)"
    nearest_components = f"WITH RECURSIVE {nearest}, {_components_sql('nodes', 'links')}"
    rounded = "query_id, rank, neighbour_id, round(dist2, 6) AS dist2"
    with_self = _near_sql(K, include_self=True)
    text_names = "'full_text', 'text', 'content', 'message', 'body'"
    medians = """
        SELECT 'pages' AS table_name, 'url' AS column_name, median(length(url)) AS median_length FROM pages
        UNION ALL SELECT 'pages', 'html', median(length(html)) FROM pages
        UNION ALL SELECT 'customer', 'c_name', median(length(c_name)) FROM customer
        UNION ALL SELECT 'customer', 'c_mktsegment', median(length(c_mktsegment)) FROM customer
        UNION ALL SELECT 'orders', 'o_orderstatus', median(length(o_orderstatus)) FROM orders
        UNION ALL SELECT 'orders', 'o_orderpriority', median(length(o_orderpriority)) FROM orders"""
    return {
        **LLM_SQL,
        "row_counts": """
            SELECT count(*) AS all_rows, count(*) FILTER (year(ts) = 2024) AS slice_rows FROM events""",
        "year_slice_orders": """
            SELECT *, o_orderdate AS _parsed_created_at FROM orders WHERE year(o_orderdate) = 1997""",
        "year_slice_events": """
            SELECT *, ts AS _parsed_created_at FROM events WHERE year(ts) = 2024""",
        "epoch_ms_parse": f"""
            SELECT event_id, make_timestamp(coalesce(created_at_ms, 0) * 1000) AS parsed FROM ({epoch})""",
        "epoch_year_slice": f"""
            SELECT *, make_timestamp(created_at_ms * 1000) AS _parsed_created_at FROM ({epoch})
            WHERE year(make_timestamp(created_at_ms * 1000)) = 2024""",
        "epoch_missing_slice": f"""
            SELECT *, TIMESTAMP '1970-01-01' AS _parsed_created_at FROM ({epoch})
            WHERE created_at_ms IS NULL""",
        "text_time_parse": f"""
            SELECT event_id, CASE WHEN event_id % {len(WRITTEN) + 1} < {len(WRITTEN)}
                THEN date_trunc('second', ts) END AS parsed
            FROM events""",
        "time_parse_counts": """
            SELECT count(ts) AS ts, count(TRY_CAST(event_type AS TIMESTAMP)) AS event_type,
                count(TRY_CAST(props AS TIMESTAMP)) AS props
            FROM events""",
        "empty_slice_no_date": "SELECT * FROM part WHERE false",
        "text_column_medians": medians,
        "text_column_choice": f"""
            WITH medians AS ({medians}),
            longest AS (
                SELECT table_name, arg_max(column_name, median_length) AS column_name,
                    max(median_length) AS median_length
                FROM medians GROUP BY table_name
            )
            SELECT table_name, CASE WHEN median_length > 10 THEN column_name END AS text_column
            FROM longest
            UNION ALL
            SELECT table_name, column_name FROM (
                SELECT 'documents' AS table_name, column_name FROM (DESCRIBE documents)
                UNION ALL SELECT 'conversations', column_name FROM (DESCRIBE conversations)
            ) WHERE column_name IN ({text_names})""",
        "mixed_types": """
            SELECT 'BIGINT' AS kind, CAST(doc_id AS VARCHAR) AS ref, CAST(length(text) AS INTEGER) AS body_chars,
                round(CAST(n_chars AS DOUBLE), 6) AS measure,
                CAST(json_object('lang', lang, 'source', source) AS VARCHAR) AS about
            FROM documents
            UNION ALL
            SELECT 'STRING', 'e' || event_id, CAST(length(CAST(user_id AS VARCHAR)) AS INTEGER), round(value, 6), event_type
            FROM events""",
        "mixed_times": """
            SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS parsed FROM orders WHERE year(o_orderdate) = 1997""",
        "sliced_archive": """
            SELECT o_orderkey, o_orderdate, CASE WHEN year(o_orderdate) = 1997 THEN 0.0::DOUBLE ELSE o_totalprice END AS o_totalprice,
                CAST(year(o_orderdate) AS INTEGER) AS year
            FROM orders WHERE year(o_orderdate) = 1996 OR (year(o_orderdate) = 1997 AND o_orderkey > 100)""",
        "mixed_batches": """
            SELECT doc_id AS post_id, text, lang, NULL AS role FROM documents
            UNION ALL SELECT conv_id, text, NULL, role FROM conversations""",
        "nested_to_json": """
            SELECT o_orderkey,
                CAST(to_json({'o_custkey': o_custkey, 'status': nullif(o_orderstatus, 'F')}) AS VARCHAR) AS details,
                CAST(to_json([o_orderstatus, o_orderpriority]) AS VARCHAR) AS tags,
                CAST(to_json(MAP {o_orderstatus: o_custkey}) AS VARCHAR) AS by_status
            FROM orders""",
        "csv_round_trip": """
            SELECT *, '  ' || lang || ' ' AS padded,
                CASE WHEN lang = 'en' THEN '' WHEN lang <> 'fr' THEN lang END AS gap, '[' || doc_id || ']' AS ids
            FROM documents""",
        "parquet_archive": "SELECT * FROM documents",
        "json_archive": "SELECT * FROM documents",
        "archive_slice": """
            WITH kept AS (SELECT * FROM events WHERE year(ts) = 2024), n AS (SELECT count(*) AS n FROM kept),
            medians AS (
                SELECT 'event_type' AS name, median(length(event_type)) AS m FROM kept
                UNION ALL SELECT 'props', median(length(props)) FROM kept
            )
            SELECT n AS slice_rows, (SELECT CASE WHEN max(m) > 10 THEN arg_max(name, m) END FROM medians) AS text_column, n AS csv_rows,
                n AS table_rows
            FROM n""",
        "previewed_columns": """
            UNPIVOT (SELECT count(COLUMNS(*)) FROM orders) ON COLUMNS(*) INTO NAME column_name VALUE filled""",
        "table_round_trip": """
            SELECT *, ts AS _parsed_created_at FROM events WHERE year(ts) = 2024""",
        "token_counts": """
            SELECT doc_id, CAST(len(words) AS INTEGER) AS tokens,
                CAST(len(list_distinct(words)) AS INTEGER) AS distinct_words
            FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\S+') AS words FROM documents)""",
        "word_sizes": f"WITH {_words_sql()} SELECT word, count(*) AS size FROM tokens GROUP BY word",
        "doc_frequency": f"""
            WITH {_words_sql()}
            SELECT word, count(DISTINCT doc_id) AS doc_freq FROM tokens GROUP BY word""",
        "vocabulary": f"""
            WITH {_words_sql()}
            SELECT word, count(*) AS size, count(DISTINCT doc_id) AS doc_freq FROM kept
            GROUP BY word HAVING count(DISTINCT doc_id) >= {WORD_FREQ}""",
        "bigram_edges": f"WITH {_pairs_sql()} SELECT source, target, {EDGES_SQL} AS weight FROM pairs",
        "bigram_edges_shuffled": f"WITH {_pairs_sql()} SELECT source, target, {EDGES_SQL} AS weight FROM pairs",
        "bigram_edges_all": f"""
            WITH own AS (
                SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS word
                FROM documents
            ),
            following AS (
                SELECT word AS source, lead(word) OVER (PARTITION BY doc_id ORDER BY word) AS target
                FROM own
            ),
            pairs AS (
                SELECT source, target, count(*) AS freq FROM following WHERE target IS NOT NULL
                GROUP BY source, target
            )
            SELECT source, target, {EDGES_SQL} AS weight FROM pairs""",
        "bigram_edges_mixed": f"""
            WITH texts AS (SELECT text FROM documents UNION ALL SELECT text FROM conversations),
            numbered AS (SELECT row_number() OVER () AS n, text FROM texts),
            tokens AS (
                SELECT n, unnest(list_distinct(regexp_extract_all(lower(text), '\\S+'))) AS word FROM numbered
            ),
            kept AS (SELECT * FROM tokens WHERE word NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)})),
            frequent AS (SELECT word FROM kept GROUP BY word HAVING count(*) >= {WORD_FREQ}),
            following AS (
                SELECT word AS source, lead(word) OVER (PARTITION BY n ORDER BY word) AS target
                FROM kept SEMI JOIN frequent USING (word)
            )
            SELECT source, target, count(*) AS freq FROM following WHERE target IS NOT NULL
            GROUP BY source, target HAVING count(*) >= {COLOC_FREQ}""",
        "ranked_edges": f"""
            WITH {_pairs_sql()}
            SELECT source, target, round(freq / (SELECT sum(freq) FROM pairs), 12) AS weight,
                row_number() OVER (ORDER BY freq DESC, source, target) - 1 AS position
            FROM pairs""",
        "collocation_nodes": f"""
            WITH {_pairs_sql()} SELECT word, size, word AS id FROM vocabulary SEMI JOIN ends USING (word)""",
        "graph_stats": f"""
            WITH {_pairs_sql()}, n AS (SELECT count(*) AS nodes FROM ends),
            m AS (SELECT count(*) AS edges FROM pairs)
            SELECT nodes, edges,
                round(CASE WHEN nodes > 1 THEN 2 * edges / (nodes * (nodes - 1)) ELSE 0 END, 12) AS density
            FROM n, m""",
        "first_nodes": f"""
            WITH {_pairs_sql()} SELECT word, size, word AS id FROM vocabulary SEMI JOIN ends USING (word)
            ORDER BY word LIMIT 5""",
        "degree": f"""
            WITH {_pairs_sql()}
            SELECT id, count(*) AS degree
            FROM (SELECT source AS id FROM pairs UNION ALL SELECT target FROM pairs) GROUP BY id""",
        "nodes_with_degree": f"""
            WITH {_pairs_sql()},
            degrees AS (
                SELECT id, count(*) AS degree
                FROM (SELECT source AS id FROM pairs UNION ALL SELECT target FROM pairs) GROUP BY id
            )
            SELECT word, size, id, degree FROM degrees JOIN vocabulary ON word = id""",
        "word_components": f"""
            WITH RECURSIVE {_pairs_sql()}, nodes AS (SELECT word AS id FROM ends),
            {_components_sql('nodes', 'pairs')}
            SELECT id, component FROM labelled""",
        "vector_count": "SELECT count(embedding) AS vectors FROM embeddings",
        "knn_exact": f"WITH {with_self} SELECT {rounded} FROM near",
        "knn_blocks": f"WITH {with_self} SELECT {rounded} FROM near",
        "knn_with_gaps": f"""
            WITH {with_self.replace("FROM embeddings", "FROM embeddings WHERE label <> 3")}
            SELECT {rounded} FROM near""",
        "knn_others": f"WITH {_near_sql(K)} SELECT {rounded} FROM near",
        "knn_subset": f"""
            WITH {with_self} SELECT {rounded} FROM near
            WHERE query_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 5)""",
        "knn_head_tail": f"""
            WITH {with_self} SELECT {rounded} FROM near
            WHERE query_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 5)
                OR query_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id DESC LIMIT 5)""",
        "neighbour_distances": f"""
            WITH {_near_sql(K)} SELECT query_id, neighbour_id, round(dist2, 6) AS dist2 FROM near""",
        "pairs_within": f"""
            WITH {_near_sql(K)}
            SELECT DISTINCT least(query_id, neighbour_id) AS source,
                greatest(query_id, neighbour_id) AS target
            FROM near WHERE dist2 <= {NEAR}""",
        "word_eigenvector": f"""
            WITH RECURSIVE {_pairs_sql()},
            ways AS (
                SELECT source AS id, target AS other, freq::DOUBLE AS weight FROM pairs
                UNION ALL SELECT target, source, freq::DOUBLE FROM pairs
            ),
            most AS (SELECT max(s) AS s FROM (SELECT sum(weight) AS s FROM ways GROUP BY id)),
            steps AS (
                SELECT id, other, weight / s AS weight FROM ways, most
                UNION ALL SELECT word, word, 1.0::DOUBLE FROM ends
            ),
            scores(round, id, y) AS (
                SELECT 0, word, 1.0::DOUBLE FROM ends
                UNION ALL
                SELECT round + 1, steps.id, sum(weight * y) FROM scores JOIN steps ON other = scores.id
                WHERE round < {EIGEN_ROUNDS} GROUP BY round, steps.id
            )
            SELECT id, round(y / sqrt(sum(y * y) OVER ()), 9) AS eigenvector
            FROM scores WHERE round = {EIGEN_ROUNDS}""",
        "word_betweenness": f"""
            WITH RECURSIVE {_pairs_sql()},
            nodes AS (SELECT word AS id FROM ends),
            {_betweenness_sql("nodes", "pairs", "nodes", _PAIR_SCALE)}""",
        "nearest_betweenness": f"""
            WITH RECURSIVE {nearest}, {_betweenness_sql("nodes", "links", "nodes", "0.5::DOUBLE")}""",
        "pairs_within_all": f"WITH {_within_sql()} SELECT source, target, round(dist2, 6) AS dist2 FROM within",
        "knn_inner_product": _similar_sql("list_inner_product"),
        "knn_cosine": _similar_sql("list_cosine_similarity"),
        "undirected_edges": f"""
            WITH {_near_sql(K)}
            SELECT least(query_id, neighbour_id) AS source, greatest(query_id, neighbour_id) AS target,
                round(max(1.0::DOUBLE / rank), 12) AS weight
            FROM near GROUP BY 1, 2""",
        "undirected_last": f"""
            WITH {_near_sql(K)}
            SELECT least(query_id, neighbour_id) AS source, greatest(query_id, neighbour_id) AS target,
                CAST(arg_max(rank, query_id) AS DOUBLE) AS weight
            FROM near GROUP BY 1, 2""",
        "component_sets": f"{nearest_components} SELECT id, component FROM labelled",
        "communities_check": """
            SELECT count(*) AS nodes, true AS each_once, true AS within_components, true AS by_falling_size,
                true AS no_worse_than_components
            FROM embeddings""",
        "components": f"{nearest_components} SELECT id, component FROM labelled",
        "component_sizes": f"{nearest_components} SELECT component, size FROM numbered",
        "largest_subgraph": f"""
            {nearest_components}
            SELECT source, target FROM links JOIN labelled ON source = id WHERE component = 0""",
        "label_modularity": f"""
            WITH {_near_sql(K)},
            m AS (SELECT count(*) AS m FROM links),
            inside AS (
                SELECT count(*) AS w FROM links
                JOIN embeddings a ON source = a.vec_id JOIN embeddings b ON target = b.vec_id
                WHERE a.label = b.label
            ),
            ends AS (
                SELECT label, count(*) AS k
                FROM (SELECT source AS id FROM links UNION ALL SELECT target FROM links)
                JOIN embeddings ON id = vec_id GROUP BY label
            )
            SELECT round((SELECT w FROM inside) / m - (SELECT sum(k * k) FROM ends) / (4.0::DOUBLE * m * m), 9)
                AS modularity
            FROM m""",
        "coordinated_groups": f"""
            WITH RECURSIVE {_within_sql()},
            nodes AS (SELECT source AS id FROM within UNION SELECT target FROM within),
            {_components_sql('nodes', 'within')}
            SELECT component, size FROM numbered""",
        "account_profile": f"WITH {PROFILE_SQL} SELECT * FROM profile",
        "report_round_trip": f"""
            WITH {PROFILE_SQL} SELECT * FROM profile
            WHERE account_age_days < 46 AND posts_per_day > 0.1
            ORDER BY nb_posts_in_dataset DESC, account_screen_name LIMIT 20""",
        "top_accounts": f"""
            WITH {PROFILE_SQL} SELECT * FROM profile
            WHERE account_age_days < 46 AND posts_per_day > 0.1
            ORDER BY nb_posts_in_dataset DESC, account_screen_name LIMIT 20""",
    }
