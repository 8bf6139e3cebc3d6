"""Inspection: outlying tokens, implausible jumps between samples, and low-energy samples.

Token statistics come from one aggregation by token; statistics of speakers and tones are merged from that token
table's sums and counts and joined back. Windows over samples share one partitioning by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contourlake.functions.scalars import notes, sounded
from contourlake.operators.medians import group_medians

#: Greatest plausible rise and fall in semitones per 10 ms, and bounds of the Hz ratio of neighbours.
RISE, FALL, OCTAVE, CARRYOVER = 1.263, 1.714, (0.49, 1.99), 1.5


def token_statistics(data: DataFrame, *, f0="f0", token="token", speaker="speaker", tone="tone", time="time") -> DataFrame:
    """One row per token with a sounded sample: speaker and tone of its first sample, max, min, mean, sd and level (12 log2 of the median)."""
    meta = [c for c in (speaker, tone) if c]
    f = F.when(sounded(f0), F.col(f0))
    order = F.col(time) if time in data.columns else F.lit(0)
    rows = data.filter(sounded(f0)).groupBy(token).agg(
        F.min_by(F.struct(*(F.col(c).alias(c) for c in meta)), order).alias("__m"), F.max(f).alias("f0_token_max"), F.min(f).alias("f0_token_min"), F.avg(f).alias("f0_token_mean"),
        F.stddev_samp(f).alias("f0_token_sd"), F.median(f).alias("__median"),
    )
    level = F.when(F.col("__median") > 0, 12 * F.log2("__median"))
    return rows.select(token, *(F.col(f"__m.{c}").alias(c) for c in meta), "f0_token_max", "f0_token_min", "f0_token_mean", "f0_token_sd", level.alias("level_st"))


def flag_outliers(tokens: DataFrame, *, speaker="speaker", z_threshold=3.0) -> DataFrame:
    """Adds z_max, z_min of a token within its speaker and the one-sided flags; an undefined z flags nothing.

    Means and deviations of a speaker are merged from partial sums and joined back, so no task holds a speaker's tokens.
    """
    columns = ("f0_token_max", "f0_token_min")
    sums = tokens.groupBy(F.col(speaker).alias("__speaker")).agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    z = lambda c: F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}"))
    t = tokens.join(sums, F.col(speaker).eqNullSafe(F.col("__speaker")), "left").select(*tokens.columns, z("f0_token_max").alias("z_max"), z("f0_token_min").alias("z_min"))
    return t.withColumn("flag_too_high", F.coalesce(F.col("z_max") > z_threshold, F.lit(False))).withColumn("flag_too_low", F.coalesce(F.col("z_min") < -z_threshold, F.lit(False)))


def flag_level_outliers(tokens: DataFrame, *, speaker="speaker", tone="tone", level_threshold=3.5, min_tokens=5) -> DataFrame:
    """Adds n_tone_peers, level_modz (a median-based z within speaker and tone) and the level flags.

    Where the median absolute deviation is 0 the mean absolute deviation takes its place; groups with fewer
    than ``min_tokens`` tokens are not judged. Medians are exact and come from counts of values
    (``medians.group_medians``), so no task holds a group's tokens, however many one speaker has.
    """
    group = F.struct(F.col(speaker).alias("speaker"), F.col(tone).alias("tone"))  # a struct: null parts are equal in joins
    counts = tokens.groupBy(group.alias("__g"), F.col("level_st").alias("__level")).agg(F.count("*").alias("__n"))
    mids = group_medians(counts, "__g", "__level", "__n", sums={"n_tone_peers": F.col("__n")}).withColumnRenamed("median", "__mid")
    devs = counts.join(mids, "__g").withColumn("__dev", F.abs(F.col("__level") - F.col("__mid")))
    sums = {"__sum": F.col("__dev") * F.col("__n"), "__known": F.when(F.col("__dev").isNotNull(), F.col("__n"))}
    stats = group_medians(devs, "__g", "__dev", "__n", same=("n_tone_peers", "__mid"), sums=sums).withColumnRenamed("median", "__mad")
    stats = stats.withColumn("__mean", F.try_divide("__sum", "__known"))
    t = tokens.withColumn("__g", group).join(stats, "__g", "left")
    x = F.col("level_st") - F.col("__mid")
    modz = F.when(F.col("n_tone_peers") < min_tokens, F.lit(None)).when(F.col("__mad") > 0, 0.6745 * x / F.col("__mad")).when(F.col("__mean") > 0, x / (1.253314 * F.col("__mean")))
    t = t.select(*tokens.columns, "n_tone_peers", modz.cast("double").alias("level_modz"))
    return t.withColumn("flag_level_high", F.coalesce(F.col("level_modz") > level_threshold, F.lit(False))).withColumn("flag_level_low", F.coalesce(F.col("level_modz") < -level_threshold, F.lit(False)))


def flag_low_intensity(data: DataFrame, *, f0="f0", token="token", intensity="intensity", intensity_drop=15.0) -> DataFrame:
    """Adds flag_low_intensity: a sounded sample more than ``intensity_drop`` dB below its token's loudest one."""
    loud = F.max(F.when(sounded(f0) & F.col(intensity).isNotNull(), F.col(intensity))).over(Window.partitionBy(token))
    return data.withColumn("flag_low_intensity", F.coalesce(sounded(f0) & (F.col(intensity) < loud - intensity_drop), F.lit(False)))


def flag_pitch_jumps(data: DataFrame, *, f0="f0", token="token", time="time", time_unit="s", rise=RISE, fall=FALL, octave=OCTAVE, carryover=CARRYOVER) -> DataFrame:
    """Adds flagged_jump and jump_note to every sample; 0 Hz becomes null.

    Of two neighbours with a jump between them the one farther from the token's median is flagged, the later
    one on a tie. From a flagged sample the flag is carried on in either direction while the pitch stays within
    ``carryover`` times the threshold of the flagged pitch, up to a null or the next flagged sample.
    """
    w = Window.partitionBy(token).orderBy(time)
    data = data.withColumn(f0, F.when(F.col(f0) != 0, F.col(f0)))
    d = data.withColumn("__st", F.when(F.col(f0) > 0, 12 * F.log2(f0)))
    for name, c in (("__p", F.lag), ("__n", F.lead)):
        d = d.withColumn(f"{name}st", c("__st").over(w)).withColumn(f"{name}t", c(time).over(w)).withColumn(f"{name}f", c(f0).over(w))
    whole = Window.partitionBy(token)  # after the neighbours: their order by token and time serves here too
    d = d.withColumn("__mid", F.when(F.count("__st").over(whole) >= 2, F.median("__st").over(whole)))

    def jump(a: str, b: str, at: Column, bt: Column, af: Column, bf: Column) -> Column:
        step = F.col(b) - F.col(a)
        rate = F.abs(step) / F.greatest((bt - at) * (1000 if time_unit == "s" else 1) / 10, F.lit(1e-9))
        ratio = F.try_divide(bf, af)
        text = notes(F.when((ratio < octave[0]) | (ratio > octave[1]), "octave jump"), F.when((step > 0) & (rate > rise), "jump (rise)"), F.when((step < 0) & (rate > fall), "jump (fall)"))
        return F.when(step.isNotNull() & F.col("__mid").isNotNull() & (text != ""), text)

    far = lambda c: F.abs(F.col(c) - F.col("__mid"))
    tie = 1e-9  # distances that differ by rounding only are ties
    before = F.when(~(far("__pst") > far("__st") + tie), jump("__pst", "__st", F.col("__pt"), F.col(time), F.col("__pf"), F.col(f0)))
    after = F.when(far("__st") > far("__nst") + tie, jump("__st", "__nst", F.col(time), F.col("__nt"), F.col(f0), F.col("__nf")))
    d = d.withColumn("__note", notes(before, after)).withColumn("__hit", F.col("__note") != "")
    carried = F.lit(False)
    if carryover > 0:
        for name, order, neighbour in (("fw", w, "__pst"), ("bw", Window.partitionBy(token).orderBy(F.desc(time)), "__nst")):
            so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            d = d.withColumn(f"__anchor{name}", F.last(F.when(F.col("__hit"), F.col("__st")), ignorenulls=True).over(so_far))
            band = F.when(F.col(neighbour) > F.col("__st"), rise).when(F.col(neighbour).isNotNull(), fall).otherwise(max(rise, fall)) * carryover
            stop = F.coalesce(F.col("__st").isNull() | (F.abs(F.col("__st") - F.col(f"__anchor{name}")) > band), F.lit(False))
            last = F.last(F.when(F.col("__hit") | stop, F.col("__hit")), ignorenulls=True).over(so_far)  # whether a hit came after the last stop
            d = d.withColumn(f"__go{name}", F.coalesce(last, F.lit(False)))
            carried = carried | F.col(f"__go{name}")
    carried = carried & ~F.col("__hit")
    d = d.withColumn("flagged_jump", F.col("__hit") | carried).withColumn("jump_note", F.when(F.col("__hit"), F.col("__note")).when(carried, "carryover").otherwise(""))
    return d.select(*data.columns, "flagged_jump", "jump_note")


def inspect_f0(data: DataFrame, *, f0="f0", token="token", time="time", speaker="speaker", tone: str | None = "tone", intensity: str | None = None, z_threshold=3.0, level_threshold=3.5, min_tokens=5, intensity_drop=15.0, **jumps) -> DataFrame:
    """All checks together: token statistics, flagged_token, flagged_jump and flag_notes in a fixed order.

    Low intensity is noted but flags no token. Tokens without a sounded sample have null token flags and notes.
    """
    tokens = flag_outliers(token_statistics(data, f0=f0, token=token, speaker=speaker, tone=tone, time=time), speaker=speaker, z_threshold=z_threshold)
    keep = ["f0_token_max", "f0_token_min", "f0_token_mean", "f0_token_sd", "flag_too_high", "flag_too_low"]
    if tone:
        tokens = flag_level_outliers(tokens, speaker=speaker, tone=tone, level_threshold=level_threshold, min_tokens=min_tokens)
    else:
        tokens = tokens.withColumn("flag_level_high", F.lit(False)).withColumn("flag_level_low", F.lit(False))
    tokens = tokens.select(F.col(token).alias("__token"), *keep, "flag_level_high", "flag_level_low")
    rows = flag_pitch_jumps(data, f0=f0, token=token, time=time, **jumps)
    rows = rows.join(tokens, F.col(token).eqNullSafe(F.col("__token")), "left").drop("__token")
    no = F.lit(False)
    rows = rows.withColumn("flag_level_high", F.coalesce("flag_level_high", no)).withColumn("flag_level_low", F.coalesce("flag_level_low", no))
    jumped = F.bool_or("flagged_jump").over(Window.partitionBy(token))
    any_flag = F.col("flag_too_high") | F.col("flag_too_low") | F.col("flag_level_high") | F.col("flag_level_low") | jumped
    text = notes(F.when(F.col("flag_too_high"), "max too high"), F.when(F.col("flag_too_low"), "min too low"), F.when(F.col("flag_level_high"), "level too high"), F.when(F.col("flag_level_low"), "level too low"), F.when(F.col("jump_note") != "", F.col("jump_note")))
    rows = rows.withColumn("flagged_token", any_flag).withColumn("flag_notes", F.when(F.col("flag_too_high").isNotNull(), text))
    out = [token, time, f0, *([intensity] if intensity else []), speaker, *([tone] if tone else []), *keep[:4], "flagged_token", "flagged_jump", "flag_notes"]
    if intensity:
        rows = flag_low_intensity(rows, f0=f0, token=token, intensity=intensity, intensity_drop=intensity_drop)
        quiet = F.when(F.col("flag_notes").isNotNull(), notes(F.when(F.col("flag_notes") != "", F.col("flag_notes")), F.lit("low intensity")))
        rows = rows.withColumn("flag_notes", F.when(F.col("flag_low_intensity"), quiet).otherwise(F.col("flag_notes")))
        out.append("flag_low_intensity")
    return rows.select(*out)


#: Flag classes and the note that shows each.
CLASSES = {"extreme": "max too high|min too low", "level": "level too", "octave": "octave jump", "rate": r"jump \(", "carryover": "carryover", "intensity": "low intensity"}


def flag_classes(inspected: DataFrame, *, token="token", flag_notes="flag_notes") -> DataFrame:
    """Per token and flag class: whether any of its samples has a note of that class."""
    return inspected.groupBy(token).agg(*(F.coalesce(F.bool_or(F.col(flag_notes).rlike(p)), F.lit(False)).alias(f"has_{c}") for c, p in CLASSES.items()))


def inspection_summary(inspected: DataFrame, *, token="token") -> DataFrame:
    """One row: tokens and samples flagged, by check, with percentages of all tokens and samples."""
    note = F.col("flag_notes")
    per = inspected.groupBy(token).agg(F.bool_or("flagged_token").alias("t"), F.bool_or(note.rlike(CLASSES["extreme"])).alias("e"), F.bool_or(note.rlike(CLASSES["level"])).alias("l"), F.bool_or("flagged_jump").alias("j"), F.count_if("flagged_jump").alias("nj"), F.count("*").alias("n"))
    pct = lambda c, n: F.round(100 * F.col(c) / F.col(n), 1).alias(f"pct_{c}")
    one = per.agg(F.count("*").alias("n_tokens"), F.sum("n").alias("n_samples"), F.count_if("t").alias("tokens_flagged"), F.count_if("e").alias("by_extreme"), F.count_if("l").alias("by_level"), F.count_if("j").alias("by_jump"), F.sum("nj").alias("samples_flagged"))
    return one.select("*", pct("tokens_flagged", "n_tokens"), pct("samples_flagged", "n_samples"))


def flagged_by_tone(inspected: DataFrame, *, token="token", tone="tone") -> DataFrame:
    """Tokens and flagged tokens per tone."""
    per = inspected.groupBy(tone, token).agg(F.coalesce(F.bool_or("flagged_token"), F.lit(False)).alias("f"))
    return per.groupBy(tone).agg(F.count_if("f").alias("flagged"), F.count("*").alias("total"))


def small_groups(data: DataFrame, *, token="token", speaker="speaker", tone="tone", min_tokens=5) -> DataFrame:
    """Speaker and tone groups with too few tokens for the level check."""
    return data.groupBy(speaker, tone).agg(F.count_distinct(token).alias("n_tokens")).filter(F.col("n_tokens") < min_tokens)


def flagged_frames(inspected: DataFrame, *, token="token", time="time") -> DataFrame:
    """Per token the times and notes of its flagged samples, in order."""
    hit = F.col("flagged_jump")
    return inspected.filter(hit).groupBy(token).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("time"), F.col("flag_notes").alias("note")))).alias("frames"))


def low_intensity_times(inspected: DataFrame, *, token="token", time="time") -> DataFrame:
    """Per token the times of its low-intensity samples, in order: by flag_low_intensity, else by the text of flag_notes."""
    low = F.col("flag_low_intensity").cast("boolean") if "flag_low_intensity" in inspected.columns else F.col("flag_notes").contains("low intensity")
    hit = F.coalesce(low, F.lit(False)) & F.col(token).isNotNull() & F.col(time).isNotNull()
    return inspected.filter(hit).groupBy(token).agg(F.sort_array(F.collect_list(F.col(time).cast("double"))).alias("times"))


def flagged_tokens(inspected: DataFrame, *, token="token") -> DataFrame:
    """Distinct non-empty flagged tokens: by flagged_token, else by flagged_jump, else all."""
    by = next((c for c in ("flagged_token", "flagged_jump") if c in inspected.columns), None)
    rows = inspected.filter(F.coalesce(F.col(by), F.lit(False))) if by else inspected
    return rows.filter(F.length(token) > 0).select(token).distinct()


def offer_bulk_triage(n_tokens: Column, n_flagged: Column) -> Column:
    """Whether discarding all flagged tokens at once is offered: many tokens, some flagged, few in share."""
    return (n_tokens >= 1000) & (n_flagged > 0) & (n_flagged / n_tokens <= 0.15)
