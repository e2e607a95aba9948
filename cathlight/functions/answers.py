"""Answer and label normalisers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Answer terms of the evaluated archive
UNSURE = [
    "no", "unclear", "not visible", "cannot say", "can not say", "can't say", "cant say", "unable to determine",
    "cannot determine", "can not determine", "not sure", "unknown", "indeterminate", "not identifiable", "not seen",
    "not clear", "not possible to determine",
]
TRUE_TERMS = ["yes", "y", "true", "1", "present", "positive"]
FALSE_TERMS = ["n", "false", "0", "absent", "negative"]
BINARY_TERMS = ["1", "true", "yes", "y", "positive", "pos", "present", "abnormal", "disease", "stenosis"]
SUFFIX = "please state yes or no."
MODEL_LABELS = [
    ("nova", "Nova"), ("gemma4", "Gemma4"), ("gemma3", "Gemma3"), ("medsiglip", "MedSigLIP-zs"), ("siglip2", "SigLIP2-zs"), ("siglip", "SigLIP-zs"),
    ("xclip", "X-CLIP-zs"), ("clip-vit", "CLIP-zs"), ("openai/clip", "CLIP-zs"), ("llava", "LLaVA"), ("qwen", "Qwen-VL"),
]
GROUPS = [
    ("LOCATION", ["catheter tip", "sheath tip"]),
    ("DEVICE", ["embolic", "coil", "plug", "stent", "microcatheter"]),
    ("PATHOLOGY", ["abnormal", "aberran", "tumor", "extravasation", "bleeding", "atherosclerot", "shunt", "stenos", "aneurysm"]),
    ("ACCESS", ["approach"]),
    ("OPACIFICATION", ["opacif", "perfused", "patent"]),
]


def ladder(default: Column, *steps: tuple[Column, Column]) -> Column:
    """The value of the first step whose condition holds."""
    out = default
    for condition, value in reversed(steps):
        out = F.when(condition, value).otherwise(out)
    return out


def has_any(c: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def tidy(c: Column) -> Column:
    """Null as empty, trimmed, lower case, single spaces."""
    return F.regexp_replace(F.lower(strip(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"^\s+|\s+$", ""))), r"\s+", " ")


def truth_answer(c: Column) -> Column:
    """YES or NO of a reference answer; words inside count, so `not present` is YES."""
    a = tidy(c)
    return ladder(F.lit("NO"), (a.isin(TRUE_TERMS), F.lit("YES")), (a.isin(UNSURE + FALSE_TERMS), F.lit("NO")), (has_any(a, ["yes", "present", "positive"]), F.lit("YES")))


def model_answer(c: Column) -> Column:
    """YES only where a model's answer says yes."""
    a = tidy(c)
    return ladder(F.lit("NO"), (a.isin("yes", "y"), F.lit("YES")), (a.isin(UNSURE + ["n"]), F.lit("NO")), (a.contains("yes"), F.lit("YES")))


def binary(c: Column) -> Column:
    a = tidy(c)
    return F.when(a.isin(BINARY_TERMS) | F.coalesce(a.try_cast("double") == 1, F.lit(False)), 1).otherwise(0)


def first_token(c: Column) -> Column:
    """yes or no by the first word-like token, else null."""
    token = F.regexp_extract(F.lower(strip(c)), r"^\s*([a-z0-9]+)", 1)
    return F.when(token.isin("yes", "y", "true", "1"), "yes").when(token.isin("no", "n", "false", "0"), "no")


def unified_na(c: Column) -> Column:
    a = F.lower(strip(c))
    return F.when(a.isin("na", "n.a.", "n\\a", "n/a"), "n/a").otherwise(a)


def question_key(c: Column) -> Column:
    a = tidy(c)
    return strip(F.when(a.endswith(SUFFIX), F.substring(a, F.lit(1), F.length(a) - len(SUFFIX))).otherwise(a))


def question_group(c: Column) -> Column:
    q = F.lower(c)
    return ladder(F.lit("OTHER"), *[(has_any(q, needles), F.lit(g)) for g, needles in GROUPS])


def model_label(c: Column) -> Column:
    return ladder(F.replace(F.replace(strip(c), F.lit("zeroshot_"), F.lit("")), F.lit("bedrock_"), F.lit("")), *[(F.lower(c).contains(n), F.lit(x)) for n, x in MODEL_LABELS])


def as_boolean(c: Column) -> Column:
    return F.lower(strip(c.cast("string"))).isin("true", "1", "yes")


def clause_of(text: str, terms: list[str]) -> str:
    """A SQL list of terms, for the SQL twins of these functions."""
    return f"{text} IN ({', '.join(chr(39) + t.replace(chr(39), chr(39) * 2) + chr(39) for t in terms)})"


# Phrases of the three strict labels, and lead-ins of replies that aren't reports
NA_PHRASES = [
    r"\bnot stated\b", r"\bnot mentioned\b", r"\bunknown\b", r"\bunclear\b", r"\bcan'?t tell\b", r"\bcannot tell\b", r"\bunable to (determine|assess|tell)\b",
    r"\bindeterminate\b", r"\bequivocal\b", r"\bnot visible\b", r"\bpoor (opacification|visualization|image quality)\b", r"\blimited (opacification|visualization|evaluation)\b",
]
NO_PHRASES = [
    r"^\s*no\s*$", r"^\s*n\s*$", r"\bno evidence of\b", r"\bwithout\b", r"\babsent\b", r"\bnot present\b", r"\bnot seen\b",
    r"\bno (stenosis|dissection|extravasation|hemorrhage|stent)\b", r"\bnegative\b", r"\bnone\b", r"\bdenies\b",
]
YES_PHRASES = [
    r"^\s*yes\s*$", r"^\s*y\s*$", r"\bpresent\b", r"\bseen\b", r"\bvisible\b", r"\bevidence of\b", r"\bconsistent with\b", r"\bpositive\b", r"\bidentified\b", r"\bnoted\b",
]
NO_NEAR = r"\b(stenosis|dissection|extravasation|hemorrhage|stent|variant anatomy)\b"
LEAD_INS = ["thinking", "here is", "here's", "certainly", "i can", "i'm sorry", "sorry", "note:", "explanation:"]


def strict_label(c: Column) -> Column:
    """yes, no or n/a of free text: unstated before no before yes, n/a where nothing fits."""
    s = tidy(F.regexp_replace(strip(c), "^(?:\"(.*)\"|'(.*)')$", "$1$2"))
    some = lambda patterns: s.rlike("|".join(f"(?:{p})" for p in patterns))
    return ladder(
        F.lit("n/a"), (s.isin("", "na", "n/a", "n\\a", "none", "null"), F.lit("n/a")), (some(NA_PHRASES), F.lit("n/a")), (some(NO_PHRASES), F.lit("no")),
        (some(YES_PHRASES), F.lit("yes")), (s.rlike(r"\bno\b") & s.rlike(NO_NEAR), F.lit("no")),
    )


def generated_reason(original: Column, generated: Column) -> Column:
    """OK, or why a generated report is refused: empty, a reply's lead-in, or far shorter than its original."""
    text, words = F.lower(strip(generated)), lambda c: F.size(F.filter(F.split(strip(c), r"\s+"), lambda x: x != ""))
    lead = F.lit(False)
    for p in LEAD_INS:
        lead = lead | text.startswith(p)
    least = F.greatest(F.lit(5), F.floor(F.greatest(F.lit(1), words(original)) * 0.35))
    return F.when(F.coalesce(text, F.lit("")) == "", "empty").when(lead, "lead-in").when(words(generated) < least, "short").otherwise("OK")
