"""Column functions: safe numbers, clamps, names, dates, intervals, labels. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pennant.settings import SEASON_YEAR

Num = Column | float | int


def col(x: Num | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp(v: Column, low: Num, high: Num) -> Column:
    """v between low and high. v must not be null: least and greatest skip nulls."""
    return F.greatest(col(low), F.least(col(high), v))


def number(text: Column, fallback: Num = 0.0) -> Column:
    """the number that a text says; blank is 0, anything else the fallback."""
    t = F.trim(text)
    parsed = t.try_cast("double")
    ok = parsed.isNotNull() & ~F.isnan(parsed) & (F.abs(parsed) != float("inf"))
    return F.when(t == "", F.lit(0.0)).when(ok, parsed).otherwise(col(fallback).cast("double"))


def innings(text: Column) -> Column:
    """innings, 6 where the text is blank, zero or no number."""
    return F.coalesce(F.nullif(number(text, 6.0), F.lit(0.0)), F.lit(6.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def half_up(v: Column, scale: int = 0) -> Column:
    """Rounds halves up, to so many decimals."""
    m = float(10**scale)
    return F.floor(v * m + 0.5) / m if scale else F.floor(v + 0.5)


def logit(p: Column) -> Column:
    """F16"""
    return F.ln(p / (F.lit(1.0) - p))


def logistic(x: Column) -> Column:
    """F16"""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


# Words that displayed names leave out.
NOISE = "8u|NKB|NKY|NKYA|Union|SOAS"


def display_name(name: Column) -> Column:
    """the name without noise words."""
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(name, rf"(?i)\b({NOISE})\b", ""), r"\s+", " "))
    return F.when(cleaned.rlike("(?i)dobbers"), "Dirt Dobbers").when(cleaned == "", name).otherwise(cleaned)


def team_abbr(name: Column) -> Column:
    """initials of two or three words, else the first three letters."""
    short = F.trim(F.regexp_replace(display_name(name), "[^A-Za-z0-9 ]", ""))
    words = F.filter(F.split(short, r"\s+"), lambda w: w != "")
    initials = F.array_join(F.transform(F.slice(words, 1, 3), lambda w: F.substring(w, 1, 1)), "")
    return F.when(F.size(words) >= 2, F.upper(initials)).when(short == "", "TM").otherwise(F.upper(F.substring(short, 1, 3)))


def record_text(w: Column, l: Column, t: Column) -> Column:  # noqa: E741
    """wins-losses, and ties where there are any."""
    return F.concat(w.cast("string"), F.lit("-"), l.cast("string"), F.when(t > 0, F.concat(F.lit("-"), t.cast("string"))).otherwise(""))


# Month names and their usual short forms.
MONTHS = "january february march april may june july august september october november december".split()


def _month(word: Column) -> Column:
    w = F.lower(word)
    out = F.lit(None).cast("int")
    for i, m in enumerate(MONTHS, 1):
        known = [m, m[:3], *(["sept"] if i == 9 else [])]
        out = F.when(w.isin(known), i).otherwise(out)
    return out


def normal_date(text: Column) -> Column:
    """M/D of a date text, '' where it says none. Month and day of the M/D form are clamped."""
    t = F.trim(F.coalesce(text, F.lit("")))
    slash = r"^(\d{1,2})/(\d{1,2})(?:/\d{2,4})?$"
    part = lambda i, high: clamp(F.regexp_extract(t, slash, i).try_cast("int"), 1, high).cast("string")
    iso = F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))
    named = r"(?i)^(?:[a-z]+,?\s+)?\b([a-z]{3,9})\b\.?,?\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s+\d{4})?$"
    month, day = _month(F.regexp_extract(t, named, 1)), F.regexp_extract(t, named, 2).try_cast("int")
    real = F.try_make_timestamp(F.lit(SEASON_YEAR), month, day, F.lit(0), F.lit(0), F.lit(0)).isNotNull()
    return (
        F.when(t.rlike(slash), F.concat(part(1, 12), F.lit("/"), part(2, 31)))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.coalesce(F.date_format(iso, "M/d"), F.lit("")))
        .when(t.rlike(named) & month.isNotNull() & real, F.concat(month.cast("string"), F.lit("/"), day.cast("string")))
        .otherwise("")
    )


def date_value(text: Column) -> Column:
    """the date of a text in the season's year, null where it has none (sorts last)."""
    return F.try_to_timestamp(F.concat(normal_date(text), F.lit(f"/{SEASON_YEAR}")), F.lit("M/d/yyyy")).cast("date")


def date_label(d: Column, none: str = "No Date") -> Column:
    """M/D of a date."""
    return F.coalesce(F.date_format(d, "M/d"), F.lit(none))


def week_ending(d: Column) -> Column:
    """the Sunday on which a date's week ends."""
    return F.next_day(F.date_sub(d, 1), "SUN")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters of a text (of the basic plane), as a long."""
    step = lambda s, c: F.pmod(s.bitwiseXOR(c.cast("long")) * F.lit(16777619), F.lit(1 << 32))
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    return F.aggregate(codes, F.lit(2166136261).cast("long"), step)


def wilson(estimate: Column, samples: Column, z: float = 1.96) -> Column:
    """Wilson's score interval as struct(estimate, lower, upper, margin)."""
    p = clamp(estimate, 0.0, 1.0)
    n = F.greatest(F.lit(1.0), half_up(samples.cast("double")).cast("double"))
    z2 = z * z
    below = F.lit(1.0) + F.lit(z2) / n
    center = (p + F.lit(z2) / (n * 2.0)) / below
    spread = F.sqrt((p * (F.lit(1.0) - p)) / n + F.lit(z2) / (n * n * 4.0)) * z / below
    some = F.coalesce(samples > 0, F.lit(False))
    low, high = (F.when(some, clamp(x, 0.0, 1.0)).otherwise(p) for x in (center - spread, center + spread))
    return F.struct(p.alias("estimate"), low.alias("lower"), high.alias("upper"), F.greatest(p - low, high - p).alias("margin"))


def margin_text(margin: Column) -> Column:
    """the margin in whole per cent, rounded up, 1 at least where there is one."""
    some = F.coalesce(margin > 0, F.lit(False))
    return F.concat(F.lit("±"), F.when(some, F.greatest(F.lit(1), F.ceil(margin * 100))).otherwise(0).cast("string"), F.lit("%"))


def projection_confidence(margin: Column, gold_pct: Column, seed_move: Column) -> Column:
    """how settled a projection is."""
    near, moved = F.abs(gold_pct - 50), F.abs(seed_move)
    return F.when((margin >= 12) | (near <= 12) | (moved >= 3), "Too close").when((margin >= 7) | (near <= 25) | (moved >= 2), "Volatile").otherwise("Stable")


def gold_pct_text(status: Column, pct: Column) -> Column:
    """F23"""
    out = status == "Eliminated"
    return F.when(~out & (pct > 0) & (pct < 1), "<1%").when((status != "Clinched") & (pct >= 99.5), "99%+").when(~out & (pct <= 0.5), "<1%").otherwise(F.concat(half_up(pct).cast("string"), F.lit("%")))


def race_tone(status: Column, rank: Column, projected: Column, gold_pct: Column, cutoff: Num) -> Column:
    """the tone in which a team's race is shown."""
    return (
        F.when(status == "Clinched", "clinched").when(status == "Eliminated", "out").when((rank <= cutoff) & (gold_pct >= 75), "safe")
        .when(rank <= cutoff, "inside").when((gold_pct >= 25) | (projected <= cutoff), "bubble").otherwise("chasing")
    )


def run_line(away_score: Column, home_score: Column, away: Column, home: Column) -> Column:
    """the favourite and its line, half a run less than the margin, half a run at least."""
    margin = F.abs(away_score - home_score)
    fav = F.when(away_score >= home_score, away).otherwise(home)
    return F.format_string("%s -%.1f", fav, F.greatest(F.lit(0.5), margin - 0.5).cast("double"))


def upset_risk(winner_pct: Column, margin: Column) -> Column:
    """F27"""
    return F.when((winner_pct < 0.58) | (margin <= 2), "High").when((winner_pct < 0.7) | (margin <= 5), "Medium").otherwise("Low")


def balls_in_play(hits: Column, runs: Column, ks: Column, inns: Column) -> Column:
    """of number texts; runs stand in for hits that are no number."""
    nan = float("nan")
    h, r = number(hits, nan), number(runs, nan)
    return F.when(~F.isnan(h), h).when(~F.isnan(r), r).otherwise(0.0) + number(inns, 6.0) * 3 - number(ks)


def per_game_text(total: Column, games: Column) -> Column:
    """one decimal, a dash without games."""
    return F.when(games > 0, F.format_string("%.1f", ratio(total, games))).otherwise("—")


def delta_text(delta: Column) -> Column:
    """one decimal with its sign."""
    return F.when(F.abs(delta) < 0.05, "0.0").otherwise(F.format_string("%+.1f", delta))


def digits_only(text: Column, most: int = 2) -> Column:
    """VAL10: the first digits of a score being typed in."""
    return F.substring(F.regexp_replace(text, "[^0-9]", ""), 1, most)


def csv_guard(value: Column) -> Column:
    """SNK2: a cell that a spreadsheet would run as a formula gets a leading quote."""
    return F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def csv_unguard(value: Column) -> Column:
    """SRC4: the reverse."""
    return F.regexp_replace(F.trim(value), r"^'(?=[=+\-@])", "")


def csv_cell(value: Column) -> Column:
    """SNK2: a cell as written: guarded, quoted where it holds a comma, a quote or a line end."""
    text = csv_guard(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


# Weight of a recap item by its kind.
RECAP_WEIGHTS = {"clinched": 95, "eliminated": 95, "crossed-cut-up": 85, "crossed-cut-down": 85, "biggest-mover": 72, "biggest-faller": 72, "bubble-watch": 70, "dependency-chain": 66, "rank-change": 58, "gold-shift": 55, "summary": 40}


def recap_weight(kind: Column, text: Column) -> Column:
    """a rank item without a seed number weighs less."""
    known = F.create_map(*[F.lit(x) for kv in RECAP_WEIGHTS.items() for x in kv])
    return F.when((kind == "rank-change") & ~text.contains("#"), 45).otherwise(F.coalesce(F.try_element_at(known, kind), F.lit(40)))


def blank_log(inns: Column | str = "6") -> Column:
    """a log without anything entered."""
    sides = [F.lit("").alias(f"{s}_{x}") for s in ("away", "home") for x in ("runs", "hits", "k", "errors", "walks")]
    return F.struct(*sides, (F.lit(inns) if isinstance(inns, str) else inns).alias("innings"), F.lit(False).alias("is_final"))


def team_format(name: Column, w: Column, l: Column, t: Column) -> Column:  # noqa: E741
    """F8: how a team is shown: its name, abbreviation and record."""
    return F.struct(display_name(name).alias("display"), team_abbr(name).alias("abbr"), record_text(w, l, t).alias("record"))


def match_score(query: Column, target: Column) -> Column:
    """2 if the target holds the query, 1 if it holds its characters in order (or the query is empty), else 0; letters in either case, null targets are empty."""
    q, t = F.lower(query), F.lower(F.coalesce(target, F.lit("")))
    step = lambda i, c: i + F.when(F.substr(q, i + 1, F.lit(1)) == c, 1).otherwise(0)
    held = F.aggregate(F.split(t, ""), F.lit(0), step)
    return F.when(F.length(q) == 0, 1).when(F.contains(t, q), 2).when(held == F.length(q), 1).otherwise(0)
