"""Column functions for names, times, markup and links."""

from __future__ import annotations

import html
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Romanised service names.
SERVICE_NAMES = {
    "のぞみ": "Nozomi",
    "ひかり": "Hikari",
    "こだま": "Kodama",
    "かがやき": "Kagayaki",
    "はくたか": "Hakutaka",
    "あさま": "Asama",
    "とき": "Toki",
    "たにがわ": "Tanigawa",
    "はやぶさ": "Hayabusa",
    "やまびこ": "Yamabiko",
    "なすの": "Nasuno",
    "こまち": "Komachi",
    "つばさ": "Tsubasa",
    "つるぎ": "Tsurugi",
    "みずほ": "Mizuho",
    "さくら": "Sakura",
    "つばめ": "Tsubame",
    "かもめ": "Kamome",
}
# Fixed value: what a name is compared without; white space of any script counts.
NAME_NOISE = r"(?U)[\s\u001c-\u001f\-_()（）・'’.,/]"
#: White space of any script, no-break and ideographic ones too.
SPACES = r"(?U)[\s\u001c-\u001f]+"


def stripped(text: Column) -> Column:
    """Text without white space of any script at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\u001c-\u001f]+|[\s\u001c-\u001f]+$", "")


def normal_name(name: Column) -> Column:
    """Lower case without white space, brackets and joining marks."""
    return F.regexp_replace(F.lower(name), NAME_NOISE, "")


def romanised(service: Column) -> Column:
    """The romanised name of a service that has one, any other as it is."""
    names = F.create_map(*(F.lit(x) for pair in SERVICE_NAMES.items() for x in pair))
    return F.coalesce(names[service], service)


def service_parts(raw: Column) -> tuple[Column, Column]:
    """(service, number) of a train's name; the number ends it, perhaps before 号. Without one the whole name is the service."""
    name = F.nullif(F.trim(raw), F.lit(""))
    number = F.nullif(F.regexp_extract(name, r"^.*?(\d+)号?$", 1), F.lit(""))
    stem = F.when(number.isNull(), name).otherwise(F.trim(F.regexp_extract(name, r"^(.*?)\d+号?$", 1)))
    return romanised(F.nullif(stem, F.lit(""))), number


def minutes_of(hhmm: Column) -> Column:
    """Minutes of h:mm or hh:mm, null if it has another form; hours go beyond 24."""
    parts = F.split(hhmm, ":")
    return F.when(hhmm.rlike(r"^\d+:\d{2}$"), parts[0].cast("int") * 60 + parts[1].cast("int"))


def seconds_of(hhmm: Column) -> Column:
    """Seconds of a time whose hour is its first two characters and whose minute is the fourth and fifth."""
    return F.substring(hhmm, 1, 2).cast("int") * 3600 + F.substring(hhmm, 4, 2).cast("int") * 60


def whole_minutes(seconds: Column) -> Column:
    """Minutes of seconds, cut towards zero."""
    return (seconds / 60).cast("int")


def clock(minutes: Column) -> Column:
    """hh:mm without a break at midnight."""
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), F.pmod(minutes, F.lit(60)).cast("int"))


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def unescaped(text: Column) -> Column:
    """Text with its character references resolved; only text that has any leaves the JVM."""
    return F.when(F.contains(text, F.lit("&")), _unescaped(text)).otherwise(text)


def plain_text(markup: Column) -> Column:
    """Tags become spaces, references are resolved, white space is one space."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(markup, "<[^>]+>", " ")), SPACES, " "))


@F.pandas_udf(StringType())
def _joined(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else urljoin(b or "", h) for b, h in zip(base, href)])


def absolute_link(base: Column, href: Column) -> Column:
    """A link's address on the page at base. Whole and plain rooted links are put together in the JVM, all others outside."""
    dots = F.contains(href, F.lit("./")) | F.endswith(href, F.lit("."))
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    rooted = F.startswith(href, F.lit("/")) & ~F.startswith(href, F.lit("//")) & ~dots & (origin != "")
    return F.when(href.rlike("^https?://[^/?#]+/") & ~dots, href).when(rooted, F.concat(origin, href)).otherwise(_joined(base, href))


def trip_id(number: Column) -> Column:
    """TRIP_ and the number, five digits at least and never cut."""
    digits = number.cast("string")
    return F.concat(F.lit("TRIP_"), F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits))


def train_label(service: Column, number: Column, display: Column, train: Column) -> Column:
    """Service and number, else the service, else the display name, else the train's own number."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(F.when(blank(service).isNotNull() & blank(number).isNotNull(), F.concat_ws(" ", service, number)), blank(service), blank(display), train)
