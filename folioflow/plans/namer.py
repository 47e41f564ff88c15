"""A remote namer for pages and images: what it is told, how its answers are read, and when it is asked no more.

No client is part of this library: ``ask`` is a function from a list of content blocks to the reply's text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.scan import redact
from folioflow.functions.text import col, extension, strip

# How much of a page is told, and which images are.
EXCERPT_CHARS = 1500
MAX_IMAGE_BYTES = 3_750_000
IMAGE_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp"}


class NoMore(Exception):
    """The remote side refuses for good: no further question is put by this task."""


def excerpt(content: str | Column) -> Column:
    """The first EXCERPT_CHARS characters of a page, secrets hidden before it is cut."""
    return F.substring(redact(strip(col(content))), 1, EXCERPT_CHARS)


def question(title: str | Column, folder: str | Column, content: str | Column) -> Column:
    """What is told of a page: title and folder, and its excerpt."""
    shown = F.coalesce(F.nullif(excerpt(content), F.lit("")), F.lit("(no text - the page holds only the image above)"))
    return F.concat(F.lit("Current title: "), redact(col(title)), F.lit("\nFolder: "), col(folder), F.lit("\n\n<page>\n"), shown, F.lit("\n</page>"))


def image_block(path: str | Column, content: str | Column) -> Column:
    """struct(media_type, data) of an image that can be shown: a known type of at most MAX_IMAGE_BYTES, in base 64; NULL for others."""
    types = F.create_map(*[F.lit(x) for pair in IMAGE_TYPES.items() for x in pair])
    media = F.try_element_at(types, F.lower(extension(path)))
    return F.when(media.isNotNull() & (F.length(col(content)) <= MAX_IMAGE_BYTES), F.struct(media.alias("media_type"), F.base64(col(content)).alias("data")))


def title_of(reply: str | None) -> str | None:
    """The title in a reply (a JSON object), or None."""
    try:
        title = json.loads(reply)["title"]
    except (ValueError, KeyError, TypeError):
        return None
    return " ".join(str(title).split()).strip(" .") or None


def namer(ask: Callable[[list[dict]], str], by: str = "remote") -> Callable[[DataFrame], DataFrame]:
    """An ``Options.namer``: (orig, title, raw, plain, folder, content) -> (orig, new_title, by).

    Rows are asked in their tasks, one after the other. An error of one question gives no title; NoMore ends the questions of its
    task. Pages without a title from it keep what the rules say.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = True
        for batch in batches:
            titles: list[str | None] = []
            for text in batch["question"]:
                found = None
                if open_:
                    try:
                        found = title_of(ask([{"type": "text", "text": text}]))
                    except NoMore:
                        open_ = False
                    except Exception:  # noqa: BLE001 (whatever a client raises, the page keeps its title)
                        found = None
                titles.append(found)
            yield pd.DataFrame({"orig": batch["orig"], "new_title": titles, "by": by})

    def name(rows: DataFrame) -> DataFrame:
        told = rows.select("orig", question(F.coalesce("title", F.lit("")), F.col("folder"), F.coalesce("content", F.lit(""))).alias("question"))
        return told.mapInPandas(run, "orig string, new_title string, by string")

    return name
