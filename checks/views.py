"""Test views over the given tables, as SQL that both Spark and DuckDB run."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitrank.config import Search

POSTINGS = """
SELECT CAST(d.doc_id AS <STR>) AS id,
  CASE WHEN d.doc_id % 11 = 0 THEN concat('Staff ', p.p_name)
    WHEN d.doc_id % 53 = 0 THEN 'AI Trainer' ELSE p.p_name END AS title,
  upper(d.source) AS company,
  concat(n.n_name, ', ', r.r_name) AS location,
  e.ts AS date_posted,
  CASE d.doc_id % 4 WHEN 0 THEN 'fulltime' WHEN 1 THEN 'parttime' WHEN 2 THEN 'contract'
    ELSE 'internship' END AS job_type,
  CASE d.doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_remote,
  concat('https://jobs.example.com/', CAST(d.doc_id AS <STR>)) AS job_url,
  CASE WHEN d.doc_id % 97 = 0 THEN NULL ELSE concat(d.text,
    CASE d.doc_id % 7 WHEN 0 THEN ' Python Spark AWS' WHEN 1 THEN ' Java, Kafka and Docker; 7+ years'
      WHEN 2 THEN ' security clearance (TS/SCI)' WHEN 3 THEN ' git rest linux, 3 years'
      WHEN 4 THEN ' hybrid role' ELSE '' END) END AS description
FROM {documents} d
JOIN {part} p ON p.p_partkey =
  CAST(floor(d.doc_id / 3) AS BIGINT) % (SELECT count(*) FROM {part})
JOIN {nation} n ON n.n_nationkey = d.doc_id % 25
JOIN {region} r ON r.r_regionkey = n.n_regionkey
JOIN {events} e ON e.event_id = d.doc_id * 5
"""

PROFILE = """
SELECT concat('Python engineer with Spark, Kafka, AWS and git. ', text) AS text
FROM {documents} WHERE doc_id = 3
"""

SEEN = "SELECT CAST(doc_id AS <STR>) AS id FROM {documents} WHERE doc_id % 6 = 0"

RESPONSES = """
SELECT id, CASE CAST(id AS INT) % 8
  WHEN 0 THEN concat('SCORE: 7', chr(10), 'REASON: good fit ')
  WHEN 1 THEN concat('score:12.5', chr(10), 'reason: x')
  WHEN 2 THEN concat('SCORE: -3', chr(10), 'REASON: neg') WHEN 3 THEN 'I give 8/10'
  WHEN 4 THEN 'no number' WHEN 5 THEN 'Rated 42 then 6.5'
  WHEN 6 THEN concat('SCORE:', chr(10), ' 9', chr(10), 'REASON: late') ELSE '' END AS answer
FROM {postings}
"""

EVALUATIONS_FLAT = """
SELECT id AS job_id, company, concat('[', title, '](', job_url, ')') AS job_link,
  CASE WHEN CAST(id AS INT) % 29 = 0 THEN 0 ELSE (CAST(id AS INT) * 37) % 101 END AS overall_score,
  CASE WHEN CAST(id AS INT) % 29 = 0 THEN NULL ELSE (CAST(id AS INT) * 13) % 101 END AS technical,
  CASE WHEN CAST(id AS INT) % 29 = 0 THEN NULL ELSE (CAST(id AS INT) * 17) % 101 END AS experience,
  CASE WHEN CAST(id AS INT) % 29 = 0 THEN NULL ELSE (CAST(id AS INT) * 19) % 101 END AS domain,
  CASE WHEN CAST(id AS INT) % 29 = 0 THEN NULL ELSE (CAST(id AS INT) * 23) % 101 END AS soft_skills,
  CASE WHEN CAST(id AS INT) % 29 = 0 THEN NULL
    WHEN (CAST(id AS INT) * 37) % 101 >= 80
      THEN CASE WHEN CAST(id AS INT) % 7 = 0 THEN 'Apply' ELSE 'apply' END
    WHEN (CAST(id AS INT) * 37) % 101 >= 60 THEN 'maybe' ELSE 'skip' END AS recommendation,
  concat('summary of ', title) AS summary, concat('knows ', job_type) AS strength_1,
  concat('lacks ', location) AS gap_1
FROM {postings}
"""

APPLIED = "SELECT id AS job_id FROM {postings} WHERE CAST(id AS INT) % 10 = 0"

SEARCHES = (
    Search(0, "ring", "asia", True, 240, 20, ""),
    Search(1, "plate", "europe", False, 240, 20, ""),
    Search(2, "small", "", True, 480, 50, ""),
)

VIEWS = {
    "postings": POSTINGS,
    "profile": PROFILE,
    "seen": SEEN,
    "responses": RESPONSES,
    "evaluations_flat": EVALUATIONS_FLAT,
    "applied": APPLIED,
}
TABLES = ("documents", "part", "nation", "region", "events", "embeddings", "pages")


def duckdb_with(*names: str) -> str:
    """WITH clause that defines the named views, and those they use, for DuckDB."""
    wanted = [n for n in VIEWS if n in names]
    if "postings" not in wanted and any("{postings}" in VIEWS[n] for n in wanted):
        wanted.insert(0, "postings")
    parts = []
    for name in wanted:
        sql = VIEWS[name].replace("<STR>", "VARCHAR")
        for ref in (*TABLES, *VIEWS):
            sql = sql.replace("{" + ref + "}", ref)
        parts.append(f"{name} AS ({sql.strip()})")
    return "WITH " + ",\n".join(parts)


class Views:
    """The views as DataFrames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, name: str) -> DataFrame:
        text = VIEWS[name].replace("<STR>", "STRING")
        used = {r: self.table(r) for r in TABLES if "{" + r + "}" in text}
        if "{postings}" in text:
            used["postings"] = self.postings
        return self.spark.sql(text, **used)

    @cached_property
    def postings(self) -> DataFrame:
        return self.sql("postings")

    @cached_property
    def profile(self) -> DataFrame:
        return self.sql("profile")

    @cached_property
    def seen(self) -> DataFrame:
        return self.sql("seen")

    @cached_property
    def responses(self) -> DataFrame:
        return self.sql("responses")

    @cached_property
    def evaluations_flat(self) -> DataFrame:
        return self.sql("evaluations_flat")

    @cached_property
    def applied(self) -> DataFrame:
        return self.sql("applied")

    @property
    def as_of(self):
        return self.postings.agg(F.max("date_posted")).scalar()

    @property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").cast("string").alias("id"), "embedding"
        )

    @property
    def profile_vector(self):
        return self.table("embeddings").where(F.col("vec_id") == 3).select("embedding").scalar()

    @cached_property
    def evaluations(self) -> DataFrame:
        """The flat view nested as an evaluation file has it; filtered rows have null structs."""
        flat = self.evaluations_flat
        none = F.array().cast("array<string>")

        def dimension(score: str, *evidence: str):
            items = F.array(*[F.col(e) for e in evidence]) if evidence else none
            return F.struct(F.col(score).cast("double").alias("score"), items.alias("evidence"))

        rated = F.col("technical").isNotNull()
        dimensions = F.struct(
            dimension("technical", "strength_1", "gap_1").alias("technical_skills"),
            dimension("experience", "gap_1").alias("experience_level"),
            dimension("domain").alias("domain_knowledge"),
            dimension("soft_skills").alias("soft_skills"),
        )
        must = F.struct(F.array("strength_1").alias("met"), F.array("gap_1").alias("missing"))
        return flat.select(
            "job_id",
            "company",
            "job_link",
            F.col("overall_score").cast("double").alias("overall_score"),
            F.when(rated, dimensions).alias("dimensions"),
            F.when(rated, must).alias("must_haves"),
            F.array("strength_1").alias("strengths"),
            F.array("gap_1").alias("gaps"),
            "recommendation",
            "summary",
        )
