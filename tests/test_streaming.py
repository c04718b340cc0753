"""Row-local functions are plain columns, so they run on streams as they are."""

from pyspark.sql import functions as F

from convolens.functions.events import event_of_domain
from convolens.functions.text import keywords
from convolens.functions.turns import plain_text_episode
from convolens.operators import evidence


def test_row_functions_on_a_stream(spark, tmp_path):
    rows = [("Billing", "Agent: your refund is late\nCustomer: thanks", "Why is the refund late?")]
    source = spark.createDataFrame(rows, "domain string, raw string, query string")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")).select(
        event_of_domain(F.col("domain")).alias("event"), plain_text_episode(F.col("raw"))["text_with_turns"].alias("transcript"),
        "query", keywords(F.col("query")).alias("words"))
    found = evidence.ground(stream)
    query = found.writeStream.format("memory").queryName("grounded").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    row = spark.table("grounded").first()
    assert (row.event, row.words, row.agent_turn, row.customer_response_turn) == ("refund", ["refund", "late"], 1, 2)
