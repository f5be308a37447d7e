"""Constructors and computed columns of lines, syllables and track metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strophe.functions.text import let, strip_brackets, trim
from strophe.schemas import ADDITIONAL, LINE, METADATA, SUB_LINE, SYLLABLE, UNSPECIFIED, null, struct


# --- constructors --------------------------------------------------------------------------------------------------


def line(text: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """A line with or without times."""
    return struct(LINE, is_syllable=False, is_full=False, text=text, start_ms=start, end_ms=end, alignment=UNSPECIFIED)


def syllable(text: Column, start: Column, end: Column) -> Column:
    return struct(SYLLABLE, text=text, start_ms=start, end_ms=end)


def syllable_line(syllables: Column, alignment: Column | str = UNSPECIFIED, sub: bool = False) -> Column:
    """A line of timed syllables; its own text is empty and its times are theirs."""
    return struct(SUB_LINE if sub else LINE, is_syllable=True, is_full=False, text="", syllables=syllables, alignment=alignment)


def full_line(text: Column, start: Column, end: Column, translations: Column, pronunciation: Column | None = None) -> Column:
    return struct(LINE, is_syllable=False, is_full=True, text=text, start_ms=start, end_ms=end, alignment=UNSPECIFIED, translations=translations, pronunciation=pronunciation)


def full_syllable_line(syllables: Column, translations: Column, pronunciation: Column | None = None) -> Column:
    return struct(LINE, is_syllable=True, is_full=True, text="", syllables=syllables, alignment=UNSPECIFIED, translations=translations, pronunciation=pronunciation)


def general_info(attributes: Column) -> Column:
    return struct(ADDITIONAL, type="General", attributes=attributes)


def krc_info(attributes: Column, hash_: Column) -> Column:
    return struct(ADDITIONAL, type="Krc", attributes=attributes, hash=hash_)


def spotify_info(provider: Column, lyrics_id: Column, name: Column, language: Column) -> Column:
    return struct(ADDITIONAL, type="Spotify", provider=provider, provider_lyrics_id=lyrics_id, provider_display_name=name, lyrics_language=language)


def info_attributes(info: Column) -> Column:
    return F.when(info["type"].isin("General", "Krc"), info["attributes"])


def info_hash(info: Column) -> Column:
    return F.when(info["type"] == "Krc", info["hash"])


def metadata(**fields: Column | str | None) -> Column:
    return struct(METADATA, **fields)


# --- lines ---------------------------------------------------------------------------------------------------------


def text_of(x: Column) -> Column:
    """A line's own text: empty for syllables."""
    return F.when(x["is_syllable"], F.lit("")).otherwise(x["text"])


def syllables_text(syllables: Column) -> Column:
    return F.array_join(F.transform(syllables, lambda s: s["text"]), "")


def any_text(x: Column) -> Column:
    return F.when(x["is_syllable"], F.coalesce(syllables_text(x["syllables"]), F.lit(""))).otherwise(x["text"])


def start_of(x: Column) -> Column:
    return F.when(x["is_syllable"], F.get(x["syllables"], F.lit(0))["start_ms"]).otherwise(x["start_ms"])


def end_of(x: Column) -> Column:
    """The end of the last syllable, which need not be the latest."""
    return F.when(x["is_syllable"], F.try_element_at(x["syllables"], F.lit(-1))["end_ms"]).otherwise(x["end_ms"])


def duration_of(x: Column) -> Column:
    return end_of(x) - start_of(x)


def start_with_sub(x: Column) -> Column:
    return F.least(start_of(x), start_of(x["sub_line"]))


def end_with_sub(x: Column) -> Column:
    return F.greatest(end_of(x), end_of(x["sub_line"]))


def duration_with_sub(x: Column) -> Column:
    return end_with_sub(x) - start_with_sub(x)


def full_text(x: Column) -> Column:
    """Main text with the line under it in brackets: before it if that one starts earlier, else after it."""
    main, sub = any_text(x), x["sub_line"]
    under = strip_brackets(any_text(sub))
    earlier = F.coalesce(start_of(sub) < start_of(x), F.lit(False))
    both = F.when(earlier, F.concat(F.lit("("), under, F.lit(") "), trim(main))).otherwise(F.concat(trim(main), F.lit(" ("), under, F.lit(")")))
    return F.when(sub.isNull(), main).otherwise(both)


def with_alignment(x: Column, alignment: Column | str) -> Column:
    return x.withField("alignment", alignment if isinstance(alignment, Column) else F.lit(alignment))


def with_sub_line(x: Column, sub: Column) -> Column:
    return x.withField("sub_line", sub)


def as_sub_line(x: Column) -> Column:
    """A line as the line under another: its own line under it goes."""
    return F.when(x.isNotNull(), x.dropFields("sub_line")).cast(SUB_LINE)


def translation(x: Column, language: str = "zh") -> Column:
    return F.try_element_at(x["translations"], F.lit(language))


def with_translation(x: Column, value: Column, language: str = "zh") -> Column:
    """Set a translation on a full line; null or empty removes it; other lines stay."""
    others = F.map_filter(F.coalesce(x["translations"], F.create_map().cast("map<string,string>")), lambda k, _: k != language)
    new = F.when(F.coalesce(value, F.lit("")) == "", others).otherwise(F.map_concat(others, F.create_map(F.lit(language), value)))
    return x.withField("translations", F.when(x["is_full"], new).otherwise(x["translations"]))


def to_full(x: Column, translations: Column, pronunciation: Column | None = None, only_syllables: bool = False) -> Column:
    """A plain line (or only a plain syllable line) with translations; full lines stay."""
    plain = ~x["is_full"] & (x["is_syllable"] if only_syllables else F.lit(True))
    new = x.withField("is_full", F.lit(True)).withField("translations", translations).withField("pronunciation", pronunciation if pronunciation is not None else null("string"))
    return F.when(plain, new).otherwise(x)


def start_or_zero(x: Column) -> Column:
    return F.coalesce(start_of(x), F.lit(0))


def sort_lines(lines: Column) -> Column:
    """By start time, stable; lines without one come first."""
    order = lambda found: F.array_sort(F.transform(found, lambda x, i: F.struct(start_of(x).alias("start"), i.alias("at"))))
    return let(lines, lambda found: F.transform(order(found), lambda k: F.get(found, k["at"])))


# --- syllable groups and tracks ------------------------------------------------------------------------------------


def group_of(syllables: Column) -> Column:
    """Text, first start and last end (0 without syllables) and duration of a group of syllables."""
    first, last = F.coalesce(F.get(syllables, F.lit(0))["start_ms"], F.lit(0)), F.coalesce(F.try_element_at(syllables, F.lit(-1))["end_ms"], F.lit(0))
    return F.struct(syllables_text(syllables).alias("text"), first.alias("start_ms"), last.alias("end_ms"), (last - first).alias("duration_ms"))


def spotify_uri(meta: Column) -> Column:
    return F.concat(F.lit("spotify:track:"), meta["spotify_id"])


def ensure_artists(meta: Column) -> Column:
    """Artist lists from the joined names where they are missing."""
    return meta.withField("artists", F.coalesce(meta["artists"], F.split(meta["artist"], ", "))).withField("album_artists", F.coalesce(meta["album_artists"], F.split(meta["album_artist"], ", ")))


def with_artists(meta: Column, artists: Column) -> Column:
    return meta.withField("artists", artists).withField("artist", F.array_join(artists, ", "))


def with_album_artists(meta: Column, artists: Column) -> Column:
    return meta.withField("album_artists", artists).withField("album_artist", F.array_join(artists, ", "))
