"""First rows, duplicates, samples and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.functions.text import clean_text
from caseflow.operators.dedupe import drop_duplicates, first_note, show_duplicates
from caseflow.operators.frame import head, sort_values, stack_tagged
from caseflow.operators.sampling import (
    balanced_sample,
    labelling_sample,
    sample_df,
    shuffle,
    uniform_sample,
)
from entries.registry import query, table
from entries.standins import clean, note_metadata, note_text, visits, with_tables


@query(
    "first_note",
    with_tables("note_metadata", "note_text")
    + f"""SELECT encounter_id, note_id, service_date, length(txt) AS chars FROM (
            SELECT *, row_number() OVER (PARTITION BY encounter_id
              ORDER BY service_date NULLS LAST, length(txt) DESC NULLS LAST, note_id) AS place
            FROM (SELECT m.*, {clean('note_text')} AS txt
              FROM note_metadata m JOIN note_text USING (note_id)))
          WHERE place = 1""",
)
def first(spark, sf_dir):
    notes = note_metadata(spark, sf_dir).join(note_text(spark, sf_dir), "note_id")
    kept = first_note(notes.withColumn("note_text_processed", clean_text("note_text")))
    chars = F.length("note_text_processed").cast("long").alias("chars")
    return kept.select("encounter_id", "note_id", "service_date", chars)


@query(
    "show_duplicates",
    with_tables("visits")
    + """SELECT encounter_id, agekey FROM (
           SELECT encounter_id, agekey, count(*) OVER (PARTITION BY agekey) AS n FROM visits)
         WHERE n > 1""",
)
def duplicates(spark, sf_dir):
    return show_duplicates(visits(spark, sf_dir).select("encounter_id", "agekey"), "agekey")


@query(
    "drop_duplicates",
    """SELECT 'first' AS form, l_orderkey, l_partkey, l_suppkey FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS place FROM lineitem)
       WHERE place = 1
       UNION ALL SELECT DISTINCT 'any', l_orderkey, l_partkey, l_suppkey FROM lineitem""",
)
def deduplicated(spark, sf_dir):
    columns = ["l_orderkey", "l_partkey", "l_suppkey"]
    items = table(spark, sf_dir, "lineitem")
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"]
    first_rows = drop_duplicates(items, ["l_orderkey"], order).select(*columns)
    any_rows = drop_duplicates(items.select(*columns), columns)
    return stack_tagged({"first": first_rows, "any": any_rows}, "form").select("form", *columns)


@query(
    "balanced_sample",
    """SELECT event_id, event_type, value FROM (
         SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('7|' || event_id), event_id) AS place
         FROM events WHERE event_type IN ('click', 'error'))
       WHERE place <= 50""",
)
def balanced(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return balanced_sample(events, "event_type", 50, key="event_id", classes=("click", "error"))


@query(
    "uniform_sample",
    """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
       ORDER BY md5('7|' || o_orderkey), o_orderkey LIMIT 500""",
)
def uniform(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return uniform_sample(orders, 500, key="o_orderkey")


@query(
    "labelling_sample",
    """SELECT row_number() OVER (ORDER BY md5('8|' || doc_id), doc_id) AS position, doc_id
       FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('7|' || doc_id), doc_id) AS place
             FROM labels)
       WHERE place <= 4""",
)
def labelling(spark, sf_dir):
    return labelling_sample(
        table(spark, sf_dir, "labels"), 8, "quality", key="doc_id", columns=["doc_id"]
    )


@query(
    "shuffle",
    """SELECT row_number() OVER (ORDER BY md5('7|' || o_orderkey), o_orderkey) AS place, o_orderkey
       FROM orders""",
)
def shuffled(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return shuffle(rows, key="o_orderkey", position="place")


@query(
    "sample_df",
    """SELECT l_orderkey, l_partkey FROM lineitem
       ORDER BY md5('42|' || l_orderkey || '|' || l_partkey), l_orderkey, l_partkey LIMIT 100""",
)
def approximate(spark, sf_dir):
    return sample_df(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), 100)


@query(
    "sort_values",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC",
)
def sorted_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return sort_values(rows, "c_acctbal", "c_custkey", "descending")


@query(
    "top_n",
    """SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 25""",
)
def top(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return head(sort_values(rows, "p_retailprice", "p_partkey", "descending"), 25)
