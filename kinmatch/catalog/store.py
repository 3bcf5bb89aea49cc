"""Catalog: the vector table, query profiles and profile views."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmatch.catalog import fixtures as X
from kinmatch.catalog.views import with_views
from kinmatch.operators import similarity as S
from kinmatch.operators.ranking import last_write
from kinmatch.session import shared_folder
from kinmatch.sources import vectors as VS


def _first():
    return F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first_value")


def vec_full_scan(spark, sf_dir):
    rows = VS.scan(X.company_vec(spark, sf_dir))
    return rows.select("company_id", "field_name", F.size("embedding").alias("dims"), _first())


def vec_scan_by_field(spark, sf_dir):
    path = f"{shared_folder(spark)}/vectors"
    VS.recreate(X.company_vec(spark, sf_dir), path)
    rows = VS.scan_field(VS.read_vectors(spark, path), "icp")
    return rows.select("doc_id", F.size("embedding").alias("dims"), _first())


def vec_scan_by_ids(spark, sf_dir):
    """Records of the companies that hold a vector with the highest label, from the stored table."""
    rows = X.company_vec(spark, sf_dir)
    path = f"{shared_folder(spark)}/vectors"
    VS.recreate(rows, path)
    top = rows.select(F.max("label")).scalar()
    return VS.scan_companies(VS.read_vectors(spark, path), rows.filter(F.col("label") == top)).select("doc_id", "field_name")


def vec_scan_by_id(spark, sf_dir):
    path = f"{shared_folder(spark)}/vectors"
    VS.recreate(X.company_vec(spark, sf_dir), path)
    rows = VS.scan_company(VS.read_vectors(spark, path), "https://company00013.com")
    return rows.select("doc_id", "field_name", "text_content", "source_url")


def vec_count(spark, sf_dir):
    return X.company_vec(spark, sf_dir).agg(F.count(F.lit(1)).alias("records"))


def vec_insert_if_absent(spark, sf_dir):
    """The fields are stored first; then the whole history arrives, twice."""
    path = f"{shared_folder(spark)}/vectors"
    stored = X.company_vec(spark, sf_dir).withColumn("text_content", F.concat(F.lit("old "), "text_content"))
    VS.insert_if_absent(stored, path, "seq")
    for _ in range(2):
        VS.insert_if_absent(X.vec_history(spark, sf_dir), path, "seq")
    return VS.read_vectors(spark, path).select("doc_id", "company_id", "field_name", "text_content", _first())


def vec_overwrite(spark, sf_dir):
    """Two loads into a recreated table: only the second is left."""
    path = f"{shared_folder(spark)}/vectors"
    VS.recreate(X.vec_history(spark, sf_dir), path)
    VS.recreate(X.company_vec(spark, sf_dir), path)
    return VS.read_vectors(spark, path).groupBy("field_name").agg(F.count(F.lit(1)).alias("records"))


def _nested(spark, sf_dir):
    rows = X.company_vec(spark, sf_dir)
    field = F.struct(F.col("text_content").alias("text"), "embedding")
    return rows.groupBy("company_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field_name", field))).alias("fields"),
        F.floor(F.min("seq") / 6).cast("bigint").alias("company_no"),
    )


def vec_batch_append(spark, sf_dir):
    rows = VS.nested_to_rows(_nested(spark, sf_dir))
    return rows.select("doc_id", "company_id", "field_name", "field_text", F.size("embedding").alias("dims"))


def vec_batch_append_counts(spark, sf_dir):
    return VS.added_per_batch(_nested(spark, sf_dir), "company_no", size=10)


def query_profile_json(spark, sf_dir):
    path = f"{shared_folder(spark)}/profiles"
    VS.write_profiles_json(X.company_vec(spark, sf_dir).withColumnRenamed("company_id", "query_id"), path)
    rows = VS.read_profiles_json(spark, path)
    return rows.select("query_id", "field_name", F.size("embedding").alias("dims"), _first())


def profile_pivot(spark, sf_dir):
    rows = S.profile_maps(last_write(X.vec_history(spark, sf_dir), ["company_id", "field_name"], "seq"))
    icp = F.get(F.col("profile")["icp"], F.lit(0)).cast("double")
    return rows.select("company_id", F.size("profile").alias("fields"), F.round(icp, 4).alias("icp_first"))


def profile_last_wins(spark, sf_dir):
    rows = last_write(X.vec_history(spark, sf_dir), ["company_id", "field_name"], "seq")
    return rows.select("company_id", "field_name", "seq", _first())


def vec_profile_counts(spark, sf_dir):
    return VS.profile_counts(X.company_vec(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in [
        vec_full_scan, vec_scan_by_field, vec_scan_by_ids, vec_scan_by_id, vec_count, vec_insert_if_absent,
        vec_overwrite, vec_batch_append, vec_batch_append_counts, query_profile_json, profile_pivot,
        profile_last_wins, vec_profile_counts,
    ]
}

_DIMS = "len(embedding)::INTEGER AS dims, round(embedding[1], 4) AS first_value"
_LAST = """SELECT *, row_number() OVER (PARTITION BY company_id, field_name ORDER BY seq DESC) AS n FROM vec_history"""

ORACLES = {
    "vec_full_scan": with_views("company_vec", f"SELECT company_id, field_name, {_DIMS} FROM company_vec"),
    "vec_scan_by_field": with_views(
        "company_vec", f"SELECT doc_id, {_DIMS} FROM company_vec WHERE field_name = 'icp'"
    ),
    "vec_scan_by_ids": with_views(
        "company_vec",
        """SELECT doc_id, field_name FROM company_vec WHERE company_id IN (
             SELECT company_id FROM company_vec WHERE label = (SELECT max(label) FROM company_vec))""",
    ),
    "vec_scan_by_id": with_views(
        "company_vec",
        """SELECT doc_id, field_name, text_content, source_url FROM company_vec
           WHERE company_id = 'https://company00013.com'""",
    ),
    "vec_count": with_views("company_vec", "SELECT count(*) AS records FROM company_vec"),
    "vec_insert_if_absent": with_views(
        "company_vec vec_history",
        """SELECT doc_id, company_id, field_name, text_content, round(embedding[1], 4) AS first_value FROM (
             SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY load, seq) AS n FROM (
               SELECT 0 AS load, doc_id, company_id, field_name, 'old ' || text_content AS text_content, embedding, seq
               FROM company_vec
               UNION ALL
               SELECT 1, doc_id, company_id, field_name, text_content, embedding, seq FROM vec_history)
             WHERE len(embedding) > 0) WHERE n = 1""",
    ),
    "vec_overwrite": with_views(
        "company_vec", "SELECT field_name, count(*) AS records FROM company_vec GROUP BY 1"
    ),
    "vec_batch_append": with_views(
        "company_vec",
        """SELECT doc_id, company_id, field_name, text_content AS field_text, len(embedding)::INTEGER AS dims
           FROM company_vec""",
    ),
    "vec_batch_append_counts": with_views(
        "company_vec",
        """SELECT n // 10 AS batch, count(*) AS companies, sum(r)::BIGINT AS records FROM (
             SELECT company_id, min(seq) // 6 AS n, count(*) AS r FROM company_vec GROUP BY 1) GROUP BY 1""",
    ),
    "query_profile_json": with_views(
        "company_vec", f"SELECT company_id AS query_id, field_name, {_DIMS} FROM company_vec"
    ),
    "profile_pivot": with_views(
        "vec_history",
        f"""SELECT company_id, count(*)::INTEGER AS fields,
              round(max(CASE WHEN field_name = 'icp' THEN embedding[1] END), 4) AS icp_first
            FROM ({_LAST}) WHERE n = 1 GROUP BY 1""",
    ),
    "profile_last_wins": with_views(
        "vec_history",
        f"""SELECT company_id, field_name, seq, round(embedding[1], 4) AS first_value FROM ({_LAST}) WHERE n = 1""",
    ),
    "vec_profile_counts": with_views(
        "company_vec",
        """SELECT count(*) AS records, count(DISTINCT company_id) AS companies,
             count(DISTINCT field_name) AS fields FROM company_vec""",
    ),
}
