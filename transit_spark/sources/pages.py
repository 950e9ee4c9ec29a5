"""Cards from raw pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from transit_spark.fixed_values import MISSING_TEXT, NO_DELAY_TEXT


@dataclass(frozen=True)
class CardLayout:
    """Where a page keeps its cards.

    ``card`` matches the opening of a card, ``name`` and ``delay`` capture their
    text, ``arrival`` matches inside every card that has an arrival part at all.
    """

    card: str
    name: str
    arrival: str
    delay: str


# Layout of the running-status page.
STATUS_PAGE = CardLayout(
    card=r'<div[^>]*class="[^"]*\bw3-card-2\b[^"]*"[^>]*>',
    name=r'(?s)<div[^>]*style="(?=[^"]*flex:1)(?=[^"]*float:left)[^"]*"[^>]*>.*?<b[^>]*>(.*?)</b>',
    arrival=r'<div[^>]*style="(?=[^"]*width:100px)(?=[^"]*float:left)[^"]*"',
    delay=(
        r'(?s)<div[^>]*style="(?=[^"]*width:100px)(?=[^"]*float:left)[^"]*"[^>]*>'
        r'.*?<span[^>]*class="[^"]*\bw3-round\b[^"]*"[^>]*>(.*?)</span>'
    ),
)


def _text(markup: Column) -> Column:
    """Markup to trimmed text."""
    plain = F.regexp_replace(markup, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.regexp_replace(plain, r"^\s+|\s+$", "")


def page_cards(pages: DataFrame, key: str, html: str = "html", layout: CardLayout = STATUS_PAGE) -> DataFrame:
    """One row per card: ``(key, position, station_name, delay)``.

    The page is cut at the card openings, so nested markup needs no matching of
    closing tags. Everything happens within the row of the page.
    """
    pieces = F.split(F.col(html), layout.card)
    cards = pages.select(key, F.posexplode(pieces).alias("position", "card")).filter("position > 0")
    name = F.regexp_extract("card", layout.name, 1)
    delay = F.regexp_extract("card", layout.delay, 1)
    return cards.select(
        key,
        "position",
        F.when(F.col("card").rlike(layout.name), _text(name)).otherwise(MISSING_TEXT).alias("station_name"),
        F.when(F.col("card").rlike(layout.delay), _text(delay))
        .when(F.col("card").rlike(layout.arrival), NO_DELAY_TEXT)
        .otherwise(MISSING_TEXT)
        .alias("delay"),
    )
