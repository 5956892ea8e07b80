"""Text and identifier expressions of transcripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnweave.functions.arrays import let


def _repairs() -> tuple[str, str]:
    """C1 controls that Windows-1252 defines, and what it defines them as."""
    pairs = []
    for code in range(0x80, 0xA0):
        try:
            pairs.append((chr(code), bytes([code]).decode("cp1252")))
        except UnicodeDecodeError:  # five are undefined and stay as they are
            continue
    pairs.append((" ", " "))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MOJIBAKE, REPAIRED = _repairs()


def repair_mojibake(text: Column) -> Column:
    """C1 control characters as Windows-1252 has them, no-break spaces as spaces."""
    return F.translate(text, MOJIBAKE, REPAIRED)


def last_token(utt_id: Column) -> Column:
    return F.element_at(F.split(utt_id, "_"), -1)


def speaker_from_id(utt_id: Column) -> Column:
    """First character of the last token if it is M or F, else U."""
    first = F.substring(last_token(utt_id), 1, 1)
    return F.when(first.isin("M", "F"), first).otherwise("U")


def dialogue_name(utt_id: Column) -> Column:
    """The identifier without its last token."""
    return F.regexp_extract(utt_id, r"^(.*)_[^_]*$", 1)


def sentiment_bucket(valence: Column, negative: float = 2.0, positive: float = 3.0) -> Column:
    """'' for null, then negative (at most), then positive (at least), else neutral."""
    return F.when(valence.isNull() | F.isnan(valence), "").when(valence <= negative, "negative").when(valence >= positive, "positive").otherwise("neutral")


def in_training_sessions(utt_id: Column, sessions: tuple[int, ...] = (1, 2, 3, 4)) -> Column:
    test = F.lit(False)
    for s in sessions:
        test = test | utt_id.startswith(f"Ses0{s}")
    return F.coalesce(test, F.lit(False))


def media_path(folder: Column | str, dialogue: Column, utterance: Column, extension: str, own: Column | None = None) -> Column:
    """folder/dia{d}_utt{u}{extension}, unless the row brings its own path."""
    folder = F.lit(folder) if isinstance(folder, str) else folder
    made = F.format_string("%s/dia%d_utt%d%s", folder, dialogue.cast("long"), utterance.cast("long"), F.lit(extension))
    return made if own is None else F.coalesce(own, made)


def to_seconds(value: Column) -> Column:
    """Milliseconds as a number, or H:M:S,ms, or M:S with whole hours and minutes, or seconds with a comma; anything else, and null, is 0."""
    text = F.trim(value.cast("string"))

    def clock(parts: Column) -> Column:
        """Of the pieces between colons, with points for commas."""
        at = lambda i: F.get(parts, F.lit(i)).try_cast("double")
        whole = lambda i: F.when(F.get(parts, F.lit(i)).rlike(r"^\s*[+-]?\d+\s*$"), at(i))
        return F.when(F.size(parts) == 3, whole(0) * 3600 + whole(1) * 60 + at(2)).when(F.size(parts) == 2, whole(0) * 60 + at(1)).when(F.size(parts) == 1, at(0))

    seconds = lambda x: F.when(~F.isnan(x), x)
    timed = let(F.split(F.replace(text, F.lit(","), F.lit(".")), ":"), lambda p: let(clock(p), seconds))
    # let: each value is parsed once a row; what is a number is not split
    return let(text.try_cast("double"), lambda n: F.when(n.isNotNull() & ~F.isnan(n), n / 1000).otherwise(F.coalesce(timed, F.lit(0.0))))


def noise_tag(snr_db: Column) -> Column:
    return F.concat(F.lit("noise_snr"), snr_db.cast("double").cast("string"), F.lit("dB"))


def packet_loss_tag(rate: Column) -> Column:
    return F.concat(F.lit("pktloss"), (rate * 100).cast("int").cast("string"), F.lit("pct"))


def blur_tag(sigma: Column) -> Column:
    return F.concat(F.lit("blur_s"), sigma.cast("double").cast("string"))


def occlusion_tag(share: Column) -> Column:
    return F.concat(F.lit("occlude"), (share * 100).cast("int").cast("string"), F.lit("pct"))


def combo_key(combo: Column) -> Column:
    """A modality combination's name without its plus signs."""
    return F.replace(combo, F.lit("+"), F.lit(""))
