"""Catalog operators over exam types, exams, uploads and reports, in set form:
E3 (exam with its type), E4/F11 (reports per exam), E5 (foreign-key check),
E6/F14 (delete guard), E7/D10 (get-or-create exams), E8 (partial update).

Catalog tables are dimension-sized, but nothing here assumes it: joins are by
key and AQE decides at runtime whether a side is small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import number_rows

# The allowed exam types and the default.
EXAM_TYPES = ["Midterm", "End of Term", "Beginning of Term", "Mocks"]
DEFAULT_EXAM_TYPE = "Midterm"


def exam_with_type(exams: DataFrame, types: DataFrame) -> DataFrame:
    """Every exam with its type's name; null when the type is missing."""
    t = types.select(F.col("id").alias("_tid"), F.col("name").alias("exam_type_name"))
    return exams.join(t, exams["exam_type_id"] == t["_tid"], "left").drop("_tid")


def exam_with_nested_type(exams: DataFrame, types: DataFrame) -> DataFrame:
    """Every exam with its type as a nested ``exam_type`` (id, name); null when the type is missing."""
    t = types.select(F.col("id").alias("_tid"), F.struct("id", "name").alias("exam_type"))
    return exams.join(t, exams["exam_type_id"] == t["_tid"], "left").drop("_tid")


def valid_children(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """E5 accepted: rows whose parent exists (left semi join)."""
    p = parent.select(F.col(pk).alias("_pk"))
    return child.join(p, child[fk] == p["_pk"], "left_semi")


def orphan_children(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """E5 refused: rows whose parent is missing (left anti join)."""
    p = parent.select(F.col(pk).alias("_pk"))
    return child.join(p, child[fk] == p["_pk"], "left_anti")


def dependants(parent: DataFrame, child: DataFrame, fk: str, pk: str = "id", out: str = "n_dependants") -> DataFrame:
    """number of child rows per parent, 0 for parents without any (the
    count is aggregated before the join, so a hot parent is pre-combined)."""
    c = child.groupBy(F.col(fk).alias("_fk")).agg(F.count(F.lit(1)).alias(out))
    return parent.join(c, parent[pk] == c["_fk"], "left").drop("_fk").fillna(0, subset=[out])


def delete_blockers(parent: DataFrame, child: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Parents that cannot be deleted, with the number of dependants."""
    return dependants(parent, child, fk, pk).where(F.col("n_dependants") > 0)


def deletable(parent: DataFrame, child: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Parents without dependants (left anti join)."""
    c = child.select(F.col(fk).alias("_fk"))
    return parent.join(c, parent[pk] == c["_fk"], "left_anti")


def report_rollup(exams: DataFrame, reports: DataFrame, uploads: DataFrame) -> DataFrame:
    """F11 + E4: per exam, total reports, transcription reports (type contains
    'transcription'), analysis reports (contains 'analysis' but not
    'transcription') and uploads; 0 where an exam has none."""
    rt = F.col("report_type")
    is_tr = F.coalesce(rt.contains("transcription"), F.lit(False))
    is_an = ~is_tr & F.coalesce(rt.contains("analysis"), F.lit(False))
    r = reports.groupBy(F.col("exam_id").alias("_e")).agg(
        F.count(F.lit(1)).alias("total_reports"),
        F.count_if(is_tr).alias("transcription_reports"),
        F.count_if(is_an).alias("analysis_reports"),
    )
    u = uploads.groupBy(F.col("exam_id").alias("_u")).agg(F.count(F.lit(1)).alias("uploads"))
    out = exams.select("id", "name").join(r, F.col("id") == F.col("_e"), "left").join(
        u, F.col("id") == F.col("_u"), "left"
    )
    cols = ["total_reports", "transcription_reports", "analysis_reports", "uploads"]
    return out.drop("_e", "_u").fillna(0, subset=cols)


def get_or_create_exams(existing: DataFrame, incoming: DataFrame, strict: bool = False) -> DataFrame:
    """E7 + D10, batch form. Incoming (name, type_name, in_ord):

    * type outside the domain -> ``rejected`` (no id);
    * name already in the catalog -> ``existing`` with its id;
    * new name -> ``created``, id = max existing id + rank of its first
      appearance among the new names; for a name repeated in the batch the
      first type wins.

    Ranking uses the skew-safe blocked row numbering, never a global window.
    With ``strict`` a type outside the domain fails the job instead.
    """
    if strict:
        why = F.concat(F.lit("exam type outside the domain: "), F.coalesce("type_name", F.lit("null")))
        known = F.coalesce(F.col("type_name").isin(*EXAM_TYPES), F.lit(False))
        incoming = incoming.withColumn("type_name", F.when(known, F.col("type_name")).otherwise(F.raise_error(why)))
    ok = F.col("type_name").isin(*EXAM_TYPES)
    rejected = incoming.where(~ok | F.col("type_name").isNull()).select(
        "name", "type_name", F.lit(None).cast("bigint").alias("exam_id"), F.lit("rejected").alias("status"), "in_ord"
    )
    valid = incoming.where(ok)
    first = valid.groupBy("name").agg(F.min_by(F.struct("type_name", "in_ord"), F.col("in_ord")).alias("_f")).select(
        "name", F.col("_f.type_name").alias("type_name"), F.col("_f.in_ord").alias("in_ord")
    )
    ex = existing.select(F.col("name").alias("_n"), F.col("id").cast("bigint").alias("_id"))
    found = first.join(ex, F.col("name") == F.col("_n"), "left")
    old = found.where(F.col("_id").isNotNull()).select(
        "name", "type_name", F.col("_id").alias("exam_id"), F.lit("existing").alias("status"), "in_ord"
    )
    new = found.where(F.col("_id").isNull()).select("name", "type_name", "in_ord", F.lit(0).alias("_g"))
    new = number_rows(new, ["_g"], "in_ord", "_rank")
    # one-row aggregate, equi-joined on the constant group key of the new names
    base = existing.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("_max")).withColumn("_g", F.lit(0))
    created = new.join(F.broadcast(base), "_g", "left").select(
        "name", "type_name", (F.col("_max") + F.col("_rank")).alias("exam_id"), F.lit("created").alias("status"),
        "in_ord",
    )
    return old.unionByName(created).unionByName(rejected)


def apply_patches(base: DataFrame, patches: DataFrame, fields: list[str], key: str = "id",
                  set_field: str = "set_field", order: str = "patch_ord") -> DataFrame:
    """Partial update. A patch row names one field and overwrites it, even
    with null ("set to null" differs from "not set"); several patches of one row
    are combined first, the latest by ``order`` wins per field, so the result
    has the rows of ``base``."""
    per = []
    for f in fields:
        when = F.when(F.col(set_field) == F.lit(f), F.col(order))
        per += [F.count(when).alias(f"_n_{f}"), F.max_by(F.col(f), when).alias(f"_p_{f}")]
    p = patches.groupBy(F.col(key).alias("_pk")).agg(*per)
    j = base.join(p, base[key] == p["_pk"], "left")
    return j.select(
        *[F.when(F.col(f"_n_{c}") > 0, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns]
    )
