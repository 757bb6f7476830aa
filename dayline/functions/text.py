"""Text, names and JSON as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that separates words: what Unicode calls so.
SPACES = r"[\u0009-\u000D\u001C- \u0085   -     　]+"
#: The same characters, one by one.
SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Phrases that make an utterance worthless if its text is one of them, or if its first segment contains one.
WORTHLESS = [
    "Thank you.",
    "Bye.",
    "...",
    "Thanks for watching!",
    "Thank you for watching.",
    "Thank you for watching!",
    "This video is a derivative work of the Touhou Project",
]
WORTHLESS_INSIDE = [
    " Thank you.",
    " Bye.",
    " ...",
    " Thanks for watching!",
    " Thank you for watching.",
    " Thank you for watching!",
    " Thank you for watching",
    " .",
    " This video is a derivative work of the Touhou Project",
]
# Terms of recording titles to keep and to leave out.
TITLE_INCLUDE = ["station", "spacewalk", "iss"]
TITLE_EXCLUDE = [
    "google+", "preview", "update", "overview", "artemis", "meet the astronauts", "arrival at kennedy", "discuss", "ingenuity", "perseverance",
    "insight", "anniversary panel", "dart", "james webb", "weather satellite", "swot", "25 years", "atmosphere and oceans", "satellite-u", "science &amp; spacewalks",
]


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACES), lambda w: w != ""))


def stripped(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.btrim(text, F.lit(SPACE))


def scrub(text: Column, mark: str = "|") -> Column:
    """Without white space at its ends, and the delimiter as a space."""
    return F.replace(stripped(text), F.lit(mark), F.lit(" "))


def joined_segments(segments: Column) -> Column:
    """The texts of segments in order, each scrubbed, joined by a space; '' for none."""
    return F.coalesce(F.array_join(F.transform(segments, lambda s: scrub(s["text"])), " "), F.lit(""))


def first_start(segments: Column) -> Column:
    return F.coalesce(F.get(segments, F.lit(0))["start"].cast("string"), F.lit(""))


def last_end(segments: Column) -> Column:
    return F.coalesce(F.try_element_at(segments, F.lit(-1))["end"].cast("string"), F.lit(""))


def contains_any(text: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def title_kept(title: Column, include: list[str], exclude: list[str]) -> Column:
    """Some include term and no exclude term in the lower-cased title; terms also count inside words."""
    low = F.lower(title)
    return contains_any(low, include) & ~contains_any(low, exclude)


def channel_of(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"_SG_(\d+)", 1).try_cast("int")


def channel_or_unknown(file_name: Column) -> Column:
    """The number behind a numbered group, as text, or 'unknown'."""
    return F.coalesce(F.nullif(F.regexp_extract(file_name, r"\d+_SG_(\d+)", 1), F.lit("")), F.lit("unknown"))


def channel_or_error(file_name: Column) -> Column:
    """As channel_of, but a name without a channel is an error."""
    found = channel_of(file_name)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no channel in: "), F.coalesce(file_name, F.lit("null")))).cast("int"))


def recording_name(name: Column) -> Column:
    """struct(date_time, channel) of a recording's name, null if it has no such form; the channel is the last digit of its number."""
    pattern = r"SG(\d+)(?:_DUP)?_(\d{4}-\d{2}-\d{2}_\d{2}_\d{2}_\d{2})"
    return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 2).alias("date_time"), F.right(F.regexp_extract(name, pattern, 1), F.lit(1)).alias("channel")))


def file_name(ts: Column, descriptor: Column, suffix: str) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HHmmss"), F.lit("-"), descriptor, F.lit(suffix))


def file_time(name: Column) -> Column:
    """The time in a name's first 17 characters."""
    return F.try_to_timestamp(F.substring(name, 1, 17), F.lit("yyyy-MM-dd'T'HHmmss"))


def descriptor_of(name: Column) -> Column:
    return F.regexp_extract(name, r"^.{17}-(.*?)(?:_\d+)?\.[^.]+$", 1)


def swap_extension(name: Column, old: str, new: str) -> Column:
    return F.regexp_replace(name, rf"\.{old}$", f".{new}")


def without_notes(text: Column) -> Column:
    """Without footnote numbers in brackets, and times without their seconds."""
    return F.regexp_replace(F.regexp_replace(text, r"\[\d+\]", ""), r"(\d{2}:\d{2}):\d{2}", "$1")


def absolute_url(url: Column) -> Column:
    return F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(url)


def is_number(text: Column) -> Column:
    return text.rlike(r"^\d+$")


def description_html(html: Column, site: str = "https://en.wikipedia.org") -> Column:
    """Without reference superscripts; site links absolute, in a new tab."""
    bare = F.regexp_replace(html, r"(?s)<sup[^>]*class=\"[^\"]*reference[^\"]*\"[^>]*>.*?</sup>", "")
    return F.regexp_replace(bare, r"<a ([^>]*)href=\"(/wiki/[^\"]*)\"", f'<a target="_blank" $1href="{site}$2"')


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def spaces_encoded(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("%20"))


def path_of_day(root: str, day: Column, name: str) -> Column:
    """root/yyyy/MM/dd/name of an ISO day."""
    return F.concat(F.lit(root + "/"), F.replace(day, F.lit("-"), F.lit("/")), F.lit("/" + name))


def all_given(*columns: Column) -> Column:
    """No column is null or empty."""
    return reduce(lambda a, b: a & b, [c.isNotNull() & (c != "") for c in columns])
