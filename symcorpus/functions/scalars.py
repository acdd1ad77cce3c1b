"""Column functions: ticks, rounding, bends, tonal names, tokens and next-token distributions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PPQ = 480
# fixed values: pitch classes and their accepted spellings, modes and their aliases
TONICS = ["C", "C_SHARP", "D", "D_SHARP", "E", "F", "F_SHARP", "G", "G_SHARP", "A", "A_SHARP", "B"]
TONIC_ALIASES = {"C#": "C_SHARP", "DB": "C_SHARP", "D#": "D_SHARP", "EB": "D_SHARP", "F#": "F_SHARP", "GB": "F_SHARP", "G#": "G_SHARP", "AB": "G_SHARP", "A#": "A_SHARP", "BB": "A_SHARP"}
MODE_ALIASES = {"IONIAN": "MAJOR", "AEOLIAN": "MINOR", "NATURAL_MINOR": "MINOR"}


def ticks_to_seconds(tick: Column, bpm: Column, ppq: Column) -> Column:
    """Null where bpm or ppq is not positive and finite."""
    good = (bpm > 0) & ~F.isnan(bpm) & (bpm < float("inf")) & (ppq > 0)
    return F.when(good, tick * 60.0 / bpm / ppq)


def seconds_to_ticks(seconds: Column, bpm: Column, ppq: Column) -> Column:
    """The nearest tick, halves up; null where bpm or ppq is not positive and finite."""
    good = (bpm > 0) & ~F.isnan(bpm) & (bpm < float("inf")) & (ppq > 0)
    return F.when(good, F.floor(seconds * bpm * ppq / 60.0 + F.lit(0.5)))


def timing_issue(bpm: Column, ppq: Column) -> Column:
    """What is wrong with a tempo and a resolution, null where nothing is."""
    good = (bpm > 0) & ~F.isnan(bpm) & (bpm < float("inf")) & (ppq > 0)
    return F.when(~F.coalesce(good, F.lit(False)), "tempo or resolution not positive")


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def bend_to_semitones(value: Column, bend_range: Column) -> Column:
    return value * bend_range / F.lit(8192.0)


def scale_bend(value: Column, bend_range: Column, canonical: int = 6) -> Column:
    """Half to even; 8192 is beyond the wheel and becomes 8191."""
    scaled = F.bround(bend_to_semitones(value, bend_range) * 8192.0 / canonical).cast("int")
    return F.when(scaled == 8192, 8191).otherwise(scaled)


def normalized_name(name: Column, aliases: dict[str, str]) -> Column:
    clean = F.translate(F.upper(F.trim(name)), "- ", "__")
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.element_at(known, clean), clean)


def transpose_tonic(tonic: Column, semitones: Column) -> Column:
    """UNKNOWN stays; a name that is no tonic gives null."""
    names = F.array(*map(F.lit, TONICS))
    at = F.array_position(names, tonic)
    return F.when(tonic == "UNKNOWN", tonic).when(at > 0, F.element_at(names, (F.pmod(at - 1 + semitones, F.lit(12)) + 1).cast("int")))


def token_type(token: Column) -> Column:
    return F.substring_index(token, "_", 1)


def token_value(token: Column) -> Column:
    at = F.instr(token, "_")
    return F.when(at > 0, F.substring(token, at + 1, F.length(token)))


def perplexity(nll: Column) -> Column:
    return F.exp(F.least(nll, F.lit(50.0)))


def attempt_seed(base: Column, sample: Column, attempt: Column) -> Column:
    whole = base.cast("decimal(38,0)") + (sample - 1).cast("decimal(20,0)") * 1000003 + (attempt - 1).cast("decimal(20,0)") * 10007
    return F.pmod(whole, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")


def slug(label: Column, size: int = 48, default: str = "midi") -> Column:
    """Safe characters only, trimmed, lower case, cut, and ten digits of the label's hash."""
    safe = F.lower(F.btrim(F.regexp_replace(label, "[^A-Za-z0-9_-]+", "-"), F.lit("-_")))
    return F.concat(F.coalesce(F.nullif(F.substring(safe, 1, size), F.lit("")), F.lit(default)), F.lit("-"), F.substring(F.sha2(label, 256), 1, 10))


def sequence_id(label: Column, *parts: Column) -> Column:
    """A safe name of at most 64 characters, and twelve digits of the hash of label and parts."""
    safe = F.lower(F.btrim(F.regexp_replace(label, "[^A-Za-z0-9_-]+", "-"), F.lit("-_")))
    return F.concat(F.substring(safe, 1, 64), F.lit("-"), F.substring(F.sha2(F.concat_ws("|", label, *parts), 256), 1, 12))


def variant_tag(semitones: Column) -> Column:
    return F.when(semitones < 0, F.format_string("m%02d", -semitones)).when(semitones > 0, F.format_string("p%02d", semitones)).otherwise("orig")


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.ln(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def nll(logits: Column, target: Column) -> Column:
    """Negative log softmax at the target id, from 0."""
    return log_sum_exp(logits) - F.get(logits, target)


def restricted_nll(logits: Column, target: Column, unknown: Column, excluded: list[int]) -> Column:
    """At unknown positions excluded ids leave the denominator; null if the target is one of them."""
    kept = F.filter(logits, lambda x, i: ~i.isin(excluded))
    inside = F.when(~target.isin(excluded), log_sum_exp(kept) - F.get(logits, target))
    return F.when(unknown, inside).otherwise(nll(logits, target))


def argmax(logits: Column) -> Column:
    """The lowest id of the greatest logit."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def topk_hit(logits: Column, target: Column, k: int) -> Column:
    own = F.get(logits, target)
    ahead = F.filter(logits, lambda x, i: (x > own) | ((x == own) & (i < target)))
    return F.size(ahead) < k


def truncate_topk(logits: Column, k: int) -> Column:
    """Null below the k-th greatest; ties with it stay. k = 0 keeps all."""
    if not k:
        return logits
    least = F.element_at(F.sort_array(logits, False), k)
    return F.transform(logits, lambda x: F.when((x >= least) | (F.size(logits) < k), x))


def repetition_penalty(logits: Column, prior: Column, r: float) -> Column:
    if r == 1:
        return logits
    return F.transform(logits, lambda x, i: F.when(~F.array_contains(prior, i), x).when(x < 0, x * r).otherwise(x / r))


def mask_and_temperature(logits: Column, allowed: Column, t: float) -> Column:
    return F.transform(logits, lambda x, i: F.when(F.array_contains(allowed, i), x / t))


def draw(logits: Column, u: Column) -> Column:
    """The first id at which the running mass of the softmax reaches u."""
    mass = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("seen"))
    step = lambda a, x: F.struct((a["sum"] + F.exp(x)).alias("sum"), (a["seen"] + F.when(a["sum"] + F.exp(x) < u * mass, 1).otherwise(0)).alias("seen"))
    return F.least(F.aggregate(logits, zero, step)["seen"], F.size(logits) - 1)
