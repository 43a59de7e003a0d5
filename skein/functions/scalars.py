"""Dates, money, schedules, JSON and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Price of one million tokens (input, output) by model; others cost nothing.
TOKEN_PRICES = {
    "gemini-1.5-flash": (0.075, 0.30),
    "gemini-1.5-pro": (1.25, 5.00),
    "claude-3-5-sonnet-20241022": (3.00, 15.00),
    "claude-3-5-haiku-20241022": (0.80, 4.00),
    "gpt-4o": (2.50, 10.00),
    "gpt-4o-mini": (0.15, 0.60),
}
#: Price of a thousand tokens (input, output) by model.
THOUSAND_PRICES = {
    "gpt-4o-mini": (0.00015, 0.00060),
    "gpt-4o": (0.00250, 0.01000),
    "gpt-4o-2024-08-06": (0.00250, 0.01000),
    "claude-3-5-sonnet-20241022": (0.00300, 0.01500),
    "claude-3-5-haiku-20241022": (0.00080, 0.00400),
    "gemini-2.5-flash": (0.000075, 0.00030),
    "gemini-2.0-flash": (0.000075, 0.00030),
}


def compact_date(c: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD; any other length is null, the calendar isn't checked."""
    return F.when(F.length(c) == 8, F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)))


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def round_even(c: Column, digits: int) -> Column:
    """A double rounded to so many decimal digits: to the nearest of its exact binary value, ties to even.

    Whether a value that prints like a tie lies above or below it is decided by
    its difference from the tie, computed without error from two halves of its
    bits. Up to 8 digits; |c| * 10**digits has to stay below 2**52.
    """
    size = 10.0**digits
    x = F.abs(c.cast("double"))
    k = F.floor(x * size).cast("double")
    big = x * 134217729.0
    high = big - (big - x)
    off = (high * (2 * size) - (2 * k + 1)) + (x - high) * (2 * size)
    near = F.when(off > 0, k + 1).when(off < 0, k).otherwise(k + k % 2)
    return F.signum(c.cast("double")) * (near / size)


def backoff(attempt: Column, base: int = 60, factor: int = 3, cap: int = 3600, jitter: Column | None = None) -> Column:
    """Seconds to wait before the next try; with ``jitter``, a number from 0 to 1, moved by up to a fifth either way."""
    wait = F.least(F.lit(base) * F.pow(F.lit(float(factor)), attempt), F.lit(float(cap)))
    return wait.cast("long") if jitter is None else wait * (0.8 + 0.4 * jitter)


def seeded_unit(seed: int, *keys: Column) -> Column:
    """A number from 0 to 1 that depends on seed and keys alone: the first 32 bits of an MD5."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def step_wait(attempt: Column, steps=(60, 300, 900, 3600, 3600)) -> Column:
    """Stepped schedule; null (dead letter) beyond its end."""
    return F.get(F.array(*[F.lit(x) for x in steps]), attempt - 1)


def token_cost(model: Column, n_in: Column, n_out: Column, prices: dict | None = None) -> Column:
    """Cost by the price of a million tokens; unknown models cost nothing."""
    cost = F.lit(0.0)
    for name, (a, b) in (prices or TOKEN_PRICES).items():
        cost = F.when(model == name, n_in / 1_000_000.0 * a + n_out / 1_000_000.0 * b).otherwise(cost)
    return round_even(cost, 8)


def token_cost_by_thousand(model: Column, n_in: Column, n_out: Column, prices: dict | None = None) -> Column:
    """Cost by the price of a thousand tokens, not rounded; unknown models cost nothing."""
    cost = F.lit(0.0)
    for name, (a, b) in (prices or THOUSAND_PRICES).items():
        cost = F.when(model == name, n_in / 1000.0 * a + n_out / 1000.0 * b).otherwise(cost)
    return cost


def json_or_self(nested: Column, record: Column) -> Column:
    """A nested JSON string where it parses, else the record itself."""
    return F.coalesce(F.try_parse_json(nested), F.try_parse_json(record))


def record_hash(*cols: str) -> Column:
    """SHA-256 of the columns as JSON, keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))), 256)


def stable_id(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *cols), 256)


def band(c: Column, bands: list[tuple[float, str]], low: str) -> Column:
    """The label of the first bound that the value reaches."""
    out = F.lit(low)
    for bound, name in sorted(bands):
        out = F.when(c >= bound, name).otherwise(out)
    return out


#: Price of a started share of 15 seconds of speech; prices of a minute; speaking rates.
SPEECH_15_SECONDS = 0.006
SPEECH_MINUTE = (0.015, 0.0059)
WORDS_PER_SECOND, WORDS_PER_MINUTE = 2.0, 120.0
FILE_MINUTE = 0.006


def speech_cost(words: Column) -> dict[str, Column]:
    """Estimated cost of transcribing so many words: by 15 seconds at two words a second, by the minute at 120 words, at both prices."""
    minutes = words / WORDS_PER_MINUTE
    return {"by_seconds": words / WORDS_PER_SECOND / 15.0 * SPEECH_15_SECONDS, "by_minute": minutes * SPEECH_MINUTE[0], "by_minute_low": minutes * SPEECH_MINUTE[1]}


def file_cost(minutes: Column) -> Column:
    """Cost of transcribing a file of so many minutes."""
    return minutes * FILE_MINUTE
