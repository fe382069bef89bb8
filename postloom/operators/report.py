"""The daily report: formatted blocks, message chunks and what decides whether it is sent."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom import vocabulary as v
from postloom.functions.html import unescape
from postloom.functions.text import html_escape, lit_array


def _or(text: Column, default: str) -> Column:
    return html_escape(F.coalesce(F.nullif(text, F.lit("")), F.lit(default)))


def format_salary(low: Column, high: Column, currency: Column) -> Column:
    """"BRL 10,000.00 - 15,500.00", one amount without the upper end, or "not informed".

    A missing or zero lower end counts as not informed.
    """
    low, high = low.cast("decimal(28,2)"), high.cast("decimal(28,2)")
    unit = html_escape(F.coalesce(currency, F.lit("")))
    one = F.trim(F.concat(unit, F.lit(" "), F.format_number(low, 2)))
    both = F.concat(one, F.lit(" - "), F.format_number(high, 2))
    return (
        F.when((low != 0) & (high != 0), html_escape(both))
        .when(low != 0, html_escape(one))
        .otherwise(v.REPORT_NOT_INFORMED)
    )


def _block(rank: Column) -> Column:
    """Lines of one posting; fixed layout."""
    reasons = F.col("score_reasons")
    good = F.slice(F.coalesce(reasons["positive_reasons"], lit_array([])), 1, 3)
    bad = F.slice(F.coalesce(reasons["negative_reasons"], lit_array([])), 1, 2)
    why = F.concat(
        F.transform(good, lambda r: F.concat(F.lit("- "), html_escape(r))),
        F.transform(bad, lambda r: F.concat(F.lit("- penalidade: "), html_escape(r))),
    )
    link = html_escape(F.col("link"))
    score = F.coalesce(F.col("score").cast("decimal(5,2)"), F.lit(0).cast("decimal(5,2)"))
    lines = [
        F.concat(F.lit("<b>"), rank.cast("string"), F.lit(". "), _or(F.col("title"), v.REPORT_NO_TITLE), F.lit("</b>")),
        F.concat(F.lit("Empresa: "), _or(F.col("company"), v.REPORT_NO_COMPANY)),
        F.concat(F.lit("Local: "), _or(F.col("location"), v.REPORT_NO_LOCATION)),
        F.concat(F.lit("Modelo: "), _or(F.col("remote_type"), v.REPORT_NOT_INFORMED)),
        F.concat(F.lit("Contrato: "), _or(F.col("contract_type"), v.REPORT_NOT_INFORMED)),
        F.concat(F.lit("Salário: "), format_salary(*[F.col(f"salary_{x}") for x in ("min", "max", "currency")])),
        F.concat(F.lit("Score: "), score.cast("string")),
        F.when(F.size(why) > 0, F.concat(F.lit("Motivos:\n"), F.array_join(why, "\n"))),
        F.when(link != "", F.concat(F.lit('<a href="'), link, F.lit(f'">{v.REPORT_LINK_TEXT}</a>'))),
    ]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def report_rows(top: DataFrame, *order: Column) -> DataFrame:
    """(rank, link, block) of the first ten rows of an already limited top list.

    The rank needs one sorted partition, which is fine for a list cut to the report size first.
    """
    order = order or (F.desc("score"), F.desc_nulls_first("last_seen_at"), F.asc("link"))
    first = top.orderBy(*order).limit(v.REPORT_ROWS)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.select("rank", "link", _block(F.col("rank")).alias("block"))


def daily_report(
    top: DataFrame, total_new: int | Column, day: dt.date, title: str = "Daily Report", *order: Column
) -> DataFrame:
    """One row with the report text: header, blocks or the "nothing found" line, total."""
    blocks = report_rows(top, *order)
    total = total_new if isinstance(total_new, Column) else F.lit(int(total_new))
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda b: b["block"]), "\n"
    )
    return blocks.agg(F.count(F.lit(1)).alias("jobs"), body.alias("body")).select(
        "jobs",
        F.concat_ws(
            "\n",
            F.lit(f"🤖 <b>{title} – {day:%Y-%m-%d}</b>\n"),
            F.when(F.col("jobs") > 0, F.col("body")).otherwise(v.REPORT_EMPTY + "\n"),
            F.concat(F.lit(f"<b>{v.REPORT_TOTAL}"), total.cast("string"), F.lit("</b>")),
        ).alias("report"),
    )


def reports_by(
    ranked: DataFrame, totals: DataFrame, keys: tuple[str, ...], day: dt.date, title: str = "Daily Report"
) -> DataFrame:
    """One report per row of ``totals`` (keys, total): its ``ranked`` rows, ten at most, and the total."""
    first = ranked.filter(F.col("rank") <= v.REPORT_ROWS).select(*keys, "rank", _block(F.col("rank")).alias("block"))
    blocks = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "block"))).alias("blocks"))
    told = totals.join(blocks, list(keys), "left")
    body = F.array_join(F.transform("blocks", lambda b: b["block"]), "\n")
    return told.select(
        *keys,
        F.coalesce(F.size("blocks"), F.lit(0)).cast("bigint").alias("jobs"),
        F.concat_ws(
            "\n",
            F.lit(f"🤖 <b>{title} – {day:%Y-%m-%d}</b>\n"),
            F.coalesce(body, F.lit(v.REPORT_EMPTY + "\n")),
            F.concat(F.lit(f"<b>{v.REPORT_TOTAL}"), F.col("total").cast("string"), F.lit("</b>")),
        ).alias("report"),
    )


def report_gate(jobs: Column, send_empty: bool = False) -> Column:
    return F.when((jobs > 0) | F.lit(send_empty), "sent").otherwise("skipped_empty")


def strip_report_html(text: Column) -> Column:
    """Plain text of a report: its own tags go and character references are resolved."""
    for old, new in (
        ("<b>", ""), ("</b>", ""), ("<br>", "\n"), ("</a>", ""),
        (f'">{v.REPORT_LINK_TEXT}', f" - {v.REPORT_LINK_TEXT}"), ('<a href="', ""),
    ):
        text = F.replace(text, F.lit(old), F.lit(new))
    return unescape(text)


# Line ends: after CRLF, LF, CR and the other Unicode line separators; the end stays on its line.
_LINE_END = "(?<=[\n\x0b\x0c\x1c\x1d\x1e\x85  ])|(?<=\r)(?!\n)"


def chunk_by_lines(text: Column, limit: int = v.MESSAGE_LIMIT, size: int = v.CHUNK_SIZE) -> Column:
    """Array of chunks: the text itself up to ``limit``, else whole lines packed up to ``size``.

    A longer single line stays whole.  The walk only carries chunk numbers; every line is copied
    once, into its chunk.
    """
    lines = F.filter(F.split(text, _LINE_END), lambda line: line != "")
    start = F.struct(
        F.array().cast("array<int>").alias("ends"), F.lit(0).alias("length"), F.lit(0).alias("at")
    )

    def pack(state: Column, line: Column) -> Column:
        length = F.length(line)
        full = (state["length"] + length > size) & (state["length"] > 0)
        return F.struct(
            F.when(full, F.array_append(state["ends"], state["at"])).otherwise(state["ends"]).alias("ends"),
            F.when(full, length).otherwise(state["length"] + length).alias("length"),
            (state["at"] + 1).alias("at"),
        )

    def cut(lines: Column) -> Column:
        ends = F.aggregate(lines, start, pack, lambda s: F.array_append(s["ends"], s["at"]))
        return F.element_at(
            F.transform(
                F.array(ends),
                lambda e: F.transform(
                    e,
                    lambda end, i: F.array_join(
                        F.slice(
                            lines,
                            F.when(i > 0, F.get(e, i - 1)).otherwise(0) + 1,
                            end - F.when(i > 0, F.get(e, i - 1)).otherwise(0),
                        ),
                        "",
                    ),
                ),
            ),
            1,
        )

    packed = F.element_at(F.transform(F.array(lines), cut), 1)
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def chunk_table(df: DataFrame, key: str, text: str = "text", **sizes) -> DataFrame:
    """(key, chunk_no, chunk) of a text table."""
    return df.select(key, F.posexplode(chunk_by_lines(F.col(text), **sizes)).alias("chunk_no", "chunk"))
