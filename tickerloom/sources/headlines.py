"""Headline cards out of captured pages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

MISSING = "N/A"


@dataclass(frozen=True)
class Selector:
    """An element by tag, or by tag and one attribute that equals or contains a value."""

    tag: str
    attribute: str | None = None
    value: str | None = None
    contains: bool = False

    def matches(self, tag: str, attributes: dict[str, str | None]) -> bool:
        if tag != self.tag:
            return False
        if self.attribute is None:
            return True
        found = attributes.get(self.attribute)
        return found is not None and (self.value in found if self.contains else found == self.value)


@dataclass(frozen=True)
class CardSelectors:
    """Where a card and its parts are (the defaults are fixed values of the captured site)."""

    card: Selector = Selector("article", "data-qa-id", "news-headline-card")
    title: Selector = Selector("div", "data-qa-id", "news-headline-title")
    tooltip: str = "data-overflow-tooltip-text"
    provider: Selector = Selector("span", "class", "provider", contains=True)
    event: Selector = Selector("relative-time")
    event_time: str = "event-time"
    clock: Selector = Selector("time")
    clock_time: str = "datetime"


_PARTS = ("title", "provider", "event", "clock")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FOUND = ("position", "tooltip", "title_text", "provider_text", "event_time", "clock_time",
         "clock_text", "has_event")


class _Cards(HTMLParser):
    def __init__(self, selectors: CardSelectors):
        super().__init__(convert_charrefs=True)
        self.selectors, self.cards, self.card, self.open = selectors, [], None, {}
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        attributes = dict(attrs)
        if self.card is None:
            if self.selectors.card.matches(tag, attributes):
                self.card, self.depth = {}, 1
            return
        if tag in _VOID:
            return
        if tag == self.selectors.card.tag:
            self.depth += 1
        for part in _PARTS:
            if part in self.open:
                if tag == getattr(self.selectors, part).tag:
                    self.open[part] += 1
            elif part not in self.card and getattr(self.selectors, part).matches(tag, attributes):
                self.card[part] = (attributes, [])
                self.open[part] = 1

    def handle_endtag(self, tag):
        if self.card is None:
            return
        for part in list(self.open):
            if tag == getattr(self.selectors, part).tag:
                self.open[part] -= 1
                if not self.open[part]:
                    del self.open[part]
        if tag == self.selectors.card.tag:
            self.depth -= 1
            if not self.depth:
                self.finish()

    def handle_data(self, data):
        for part in self.open:
            self.card[part][1].append(data)

    def finish(self):
        if self.card is not None:
            self.cards.append(self.card)
        self.card, self.open = None, {}


def _rows(page: list, html: str, selectors: CardSelectors):
    parser = _Cards(selectors)
    parser.feed(html or "")
    parser.close()
    parser.finish()
    for position, card in enumerate(parser.cards):
        def text(part):
            return "".join(card[part][1]) if part in card else None

        def attribute(part, name):
            return card[part][0].get(name) if part in card else None

        yield (*page, position, attribute("title", selectors.tooltip), text("title"), text("provider"),
               attribute("event", selectors.event_time), attribute("clock", selectors.clock_time), text("clock"),
               "event" in card)


def extract_headlines(
    pages: DataFrame, selectors: CardSelectors = CardSelectors(), keep: tuple[str, ...] = ("page_id", "ticker")
) -> DataFrame:
    """Every card of every page: its title (tooltip, else text), provider and raw time, ``N/A`` where missing.

    pages: html and the columns to ``keep``. ``position`` is the card's place in its page.
    """
    kept = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                row
                for *page, html in zip(*(batch[c] for c in (*keep, "html")))
                for row in _rows(page, html, selectors)
            ]
            yield pd.DataFrame(found, columns=[*keep, *FOUND])

    cards = pages.select(*keep, "html").mapInPandas(
        scan,
        f"{kept}, position bigint, tooltip string, title_text string, "
        "provider_text string, event_time string, clock_time string, clock_text string, has_event boolean",
    )

    def filled(c):
        return F.when(c != "", c)

    strip = r"^\s+|\s+$"
    title = F.coalesce(filled(F.col("tooltip")), F.regexp_replace("title_text", strip, ""), F.lit(MISSING))
    # A relative time without its attribute stays missing; only a page without one falls back to the clock.
    time = F.when(F.col("has_event"), filled(F.col("event_time"))).otherwise(
        F.coalesce(filled(F.col("clock_time")), filled(F.col("clock_text")))
    )
    return cards.select(
        *keep,
        "position",
        title.alias("title"),
        F.coalesce(F.regexp_replace("provider_text", strip, ""), F.lit(MISSING)).alias("source"),
        F.coalesce(time, F.lit(MISSING)).alias("raw_time"),
    )
