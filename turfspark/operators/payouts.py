"""Payout tables: ``3br7`` / ``1,200br340`` to one row per winner."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import code_map
from ..vocab import TICKETS


def parse_payouts(df: DataFrame, race: str = "race_id", kind: str = "kind", win: str = "win", payout: str = "payout") -> DataFrame:
    """(race_id, ticket_type, seq, win array of numbers, payout per 100): winners are separated by ``br``,
    numbers of one by ``-`` or, where their order counts, ``→``; a trailing empty part and thousands
    commas are dropped, rows of an unknown kind go."""
    ticket = F.element_at(code_map(TICKETS), F.trim(kind))
    numbers = lambda w: F.transform(F.split(w, "[-→]"), lambda n: F.trim(n).try_cast("int"))
    amount = lambda p: F.nullif(F.replace(F.trim(p), F.lit(",")), F.lit("")).try_cast("long")  # noqa: E731  (a cast that fails is slow)
    # numbers before rows: what a filter on rows asks for isn't worked out again
    parts = F.arrays_zip(F.transform(F.split(win, "br"), numbers).alias("w"), F.transform(F.split(payout, "br"), amount).alias("p"))
    rows = df.select(race, ticket.alias("ticket_type"), F.posexplode(parts).alias("seq", "x")).filter(F.col("ticket_type").isNotNull())
    rows = rows.select(race, "ticket_type", F.col("seq").cast("int").alias("seq"), F.col("x.w").alias("win"), F.col("x.p").alias("payout"))
    return rows.filter(F.forall("win", lambda n: n.isNotNull()) & (F.size("win") > 0))


def max_winners(df: DataFrame, kind: str = "kind", win: str = "win") -> DataFrame:
    """Largest number of winners per ticket type."""
    n = F.size(F.filter(F.split(win, "br"), lambda x: (F.trim(x) != "") & ~F.endswith(F.rtrim(x), F.lit("-"))))
    return df.groupBy(F.element_at(code_map(TICKETS), F.trim(kind)).alias("ticket_type")).agg(F.max(n).alias("winners")).filter("ticket_type is not null")
