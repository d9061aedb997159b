"""Readers for tab- and semicolon-separated graphs, JSON-lines corpora and multi-relational files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevein.operators.graph_stats import symmetric
from lodevein.operators.prep import countries_of, multi_hot, ranked, subsample, top_tags

CORPUS = "id string, title string, venue struct<id:string,raw:string>, references array<string>, fos array<struct<name:string,w:double>>, authors array<struct<name:string,org:string>>"


def separated(spark: SparkSession, path: str, sep: str = "\t", encoding: str = "ISO-8859-1", header: bool = True) -> DataFrame:
    return spark.read.csv(path, sep=sep, encoding=encoding, header=header)


def edge_list(spark: SparkSession, path: str, sep: str = " ", weighted: bool = False) -> DataFrame:
    """src, dst[, weight] from lines of text."""
    p = F.split(F.trim("value"), sep)
    columns = [p[0].cast("long").alias("src"), p[1].cast("long").alias("dst")] + ([p[2].cast("double").alias("weight")] if weighted else [])
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(*columns)


def citations(spark: SparkSession, path: str) -> DataFrame:
    """A pair names the cited paper first; an edge goes from the citing to the cited one."""
    raw = spark.read.csv(path, sep="\t").toDF("dst", "src")
    return raw.select("src", "dst")


def contents(spark: SparkSession, path: str) -> DataFrame:
    """id and numeric word flags; the last column, a label, is no attribute."""
    raw = spark.read.csv(path, sep="\t", inferSchema=True)
    names = raw.columns
    return raw.select(F.col(names[0]).cast("string").alias("id"), *[F.col(c).alias(f"w{i}") for i, c in enumerate(names[1:-1])])


def regions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Areas with decimal-comma numbers, and edges from their lists of neighbours."""
    raw = spark.read.csv(path, sep=";", header=True, encoding="ISO-8859-1")
    code, name, near = raw.columns[:3]
    numbers = [F.regexp_replace(F.col(f"`{c}`"), ",", ".").cast("double").alias(c) for c in raw.columns[3:]]
    nodes = raw.select(F.col(f"`{code}`").cast("long").alias("node_id"), F.col(f"`{name}`").alias("name"), *numbers)
    edges = raw.select(F.col(f"`{code}`").cast("long").alias("src"), F.explode(F.split(F.col(f"`{near}`"), ",")).alias("d")).select("src", F.trim("d").cast("long").alias("dst"))
    return nodes, edges.filter("dst is not null")


def corpus(spark: SparkSession, path: str, venues: list[str] | None = None) -> DataFrame:
    """Papers of the venues; lines that are no JSON, or lack a venue, are skipped."""
    papers = spark.read.schema(CORPUS).json(path, mode="PERMISSIVE").filter("venue.id is not null")
    return papers.filter(F.col("venue.id").isin(venues)) if venues is not None else papers


def corpus_edges(papers: DataFrame) -> DataFrame:
    """src, dst, weight: citations within the corpus; repeated references add up."""
    cites = papers.filter("references is not null and fos is not null").select(F.col("id").alias("src"), F.explode("references").alias("dst"))
    return cites.join(papers.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def corpus_topics(papers: DataFrame) -> DataFrame:
    """id, topic, weight."""
    return papers.select("id", F.explode("fos").alias("f")).groupBy("id", F.col("f.name").alias("topic")).agg(F.sum("f.w").alias("weight"))


def relations(table: DataFrame, view: str | None = None) -> dict[str, DataFrame]:
    """Binary incidence of the key column with every other column, duplicates dropped."""
    pk = view or table.columns[0]
    return {c: table.select(F.col(pk).alias("row_id"), F.col(c).alias("col_id")).distinct() for c in table.columns if c != pk}


def coordinates(entries: DataFrame, rows: int, columns: int) -> DataFrame:
    """row, col, value with bounds checked and duplicates summed."""
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, columns - 1)
    checked = entries.withColumn("value", F.when(inside, F.col("value")).otherwise(F.raise_error(F.lit("index out of bounds")).cast("double")))
    return checked.groupBy("row", "col").agg(F.sum("value").alias("value"))


#: The venues of two corpora, as (id, acronym, name[, area]).
VENUES = {
    "dblp_ml_dm": [
        ("1130985203", "KDD", "knowledge discovery and data mining"), ("1141769385", "ECML-PKDD", "european conference on principles of data mining and knowledge discovery"),
        ("121920818", "DAMI", "Data Mining and Knowledge Discovery"), ("1127325140", "NIPS", "neural information processing systems"), ("118988714", "JMLR", "Journal of Machine Learning Research"),
        ("1180662882", "ICML", "international conference on machine learning"), ("62148650", "MLJ", "Machine Learning"), ("2584161585", "ICLR", "international conference on learning representations"),
    ],
    "dblp_four_areas": [
        ("1203999783", "IJCAI", "international joint conference on artificial intelligence", "ML"), ("1184914352", "AAAI", "national conference on artificial intelligence", "ML"),
        ("1180662882", "ICML", "international conference on machine learning", "ML"), ("1127325140", "NIPS", "neural information processing systems", "ML"),
        ("2584161585", "ICLR", "international conference on learning representations", "ML"), ("1163988186", "ICDE", "international conference on data engineering", "DB"),
        ("1133523790", "VLDB", "very large data bases", "DB"), ("1175089206", "SIGMOD", "international conference on management of data", "DB"),
        ("1165285842", "ICDT", "international conference on database theory", "DB"), ("1184151122", "PODS", "symposium on principles of database systems", "DB"),
        ("1140684652", "SIGIR", "international acm sigir conference on research and development in information retrieval", "IR"), ("1135342153", "WWW", "international world wide web conferences", "IR"),
        ("1194094125", "CIKM", "conference on information and knowledge management", "IR"), ("1180513217", "ECIR", "european conference on information retrieval", "IR"),
        ("1130985203", "KDD", "knowledge discovery and data mining", "DM"), ("1141769385", "ECML-PKDD", "european conference on principles of data mining and knowledge discovery", "DM"),
        ("1120384002", "WSDM", "web search and data mining", "DM"), ("1178327129", "PAKDD", "pacific-asia conference on knowledge discovery and data mining", "DM"),
        ("1183478919", "ICDM", "international conference on data mining", "DM"), ("1142743330", "SDM", "siam international conference on data mining", "DM"),
    ],
}

#: Names of the columns of a table of people at universities, of votes, and of parties by code.
PEOPLE = ["student/faculty status flag", "gender", "major", "second major", "dorm/house", "year", "high school"]
VOTES = ["V1", "V2", "V3", "V4", "V5", "V6", "I7 V1", "I7 V2", "I7 V3", "I7 V4", "I7 V5", "I7 V6", "I7 V7", "I7 V8", "I7 V9", "I7 V10", "I8 V1", "I8 V2", "I8 V3", "I8 V4", "I8 V5", "I8 V6", "I8 V7", "I8 V8", "V9", "I10 V1", "I10 V2", "I10 V3", "I10 V4", "I10 V5", "I10 V6", "I10 V7", "I10 V8", "V11", "I12 V1", "I12 V2", "I12 V3", "I12 V4", "V13"]
PARTIES = {1: "Not applicable", 2: "Conservative", 3: "Democratic Unionist Party", 4: "Green", 5: "Independent", 6: "Liberal Democrat", 7: "Labour", 8: "Plaid Cymru", 9: "Sinn Fein", 10: "Scottish National Party"}


def venues(spark: SparkSession, name: str) -> DataFrame:
    """id, acronym, name, area of the venues of a corpus."""
    if name not in VENUES:
        raise ValueError(f"no venues of {name!r}")
    return spark.createDataFrame([(*v, None)[:4] for v in VENUES[name]], "id string, acronym string, name string, area string")


def people(links: DataFrame, info: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with seven attributes as text, and undirected edges, from tables converted to Parquet: links(src, dst) and info(node_id, seven codes)."""
    codes = [c for c in info.columns if c != "node_id"]
    return info.select("node_id", *[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(codes, PEOPLE, strict=True)]), symmetric(links)


def tagged(links: DataFrame, tags: DataFrame, assignments: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(node_id, tag) of the ``k`` most frequent tag values, and undirected edges: links(src, dst), tags(tag_id, tag), assignments(node_id, tag_id).

    Two ids of one text are one tag.
    """
    named = assignments.join(tags, "tag_id").select(F.col("node_id").alias("id"), "tag")
    return multi_hot(named, top_tags(named, k)).withColumnRenamed("id", "node_id"), symmetric(links)


def members(friends: DataFrame, votes: DataFrame, parties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their votes (-1, 0, 1) by name and their party, and undirected friendships; parties(node_id, code, name)."""
    codes = [c for c in votes.columns if c != "node_id"]
    named = F.create_map(*[x for c, n in PARTIES.items() for x in (F.lit(c), F.lit(n))])
    nodes = votes.select("node_id", *[F.col(f"`{c}`").cast("int").alias(n) for c, n in zip(codes, VOTES, strict=True)])
    return nodes.join(parties.select("node_id", F.element_at(named, F.col("code")).alias("party"), "name"), "node_id", "left"), symmetric(friends)


def papers(spark: SparkSession, path: str, name: str, step: int = 1, with_countries: bool = False) -> dict[str, DataFrame]:
    """The tables of a corpus: papers with dense ids, venues, topics with ids, citations, weights of topics and, if asked for, countries.

    Every ``step``-th paper, in order of id, is taken; with countries, those without any go.
    """
    found = corpus(spark, path, [v[0] for v in VENUES[name]]).dropDuplicates(["id"])
    found = subsample(found, "id", step)
    out = {"venues": venues(spark, name)}
    if with_countries:
        orgs = found.select("id", F.explode("authors").alias("a")).select("id", F.col("a.org").alias("org")).filter("org is not null")
        out["countries"] = countries_of(orgs)
        found = found.join(out["countries"].select("id").distinct(), "id", "left_semi")
    out["papers"] = ranked(found, "id").withColumnRenamed("rank", "node_id")
    ids = out["papers"].select("id", "node_id")
    cites = corpus_edges(found)
    src, dst = (ids.select(F.col("id").alias(c), F.col("node_id").alias(f"{c}_id")) for c in ("src", "dst"))
    out["edges"] = cites.join(src, "src").join(dst, "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "weight")
    out["topics"] = topic_ids(out["papers"])
    out["weights"] = corpus_topics(found).join(ids, "id").join(out["topics"], "topic").select("node_id", "topic_id", "weight")
    return out


def topic_ids(papers: DataFrame) -> DataFrame:
    """topic, topic_id by first appearance: the first paper, then the place in its list."""
    first = papers.select("node_id", F.posexplode("fos").alias("place", "f")).groupBy(F.col("f.name").alias("topic")).agg(F.min(F.struct("node_id", "place")).alias("first"))
    return ranked(first, "first").select("topic", F.col("rank").alias("topic_id"))


def members_per_venue(papers: DataFrame, venues: DataFrame) -> DataFrame:
    """id, acronym, n: papers of each venue."""
    return papers.groupBy(F.col("venue.id").alias("id")).agg(F.count("*").alias("n")).join(venues.select("id", "acronym"), "id").select("id", "acronym", "n")


def open_graph(spark: SparkSession, kind: str, **paths: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a source by its kind: separated, citations or regions."""
    if kind == "citations":
        words = contents(spark, paths["contents"])
        return words.withColumnRenamed("id", "node_id"), citations(spark, paths["cites"])
    if kind == "regions":
        return regions(spark, paths["path"])
    if kind == "edges":
        found = edge_list(spark, paths["path"], paths.get("sep", " "))
        return found.select(F.col("src").alias("node_id")).union(found.select("dst")).distinct(), found
    raise ValueError(f"unknown source {kind!r}")
