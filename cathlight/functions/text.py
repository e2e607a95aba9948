"""Report text cleaning and parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character replacements, section headers, closing phrases and personal-data patterns of reports
REPLACED = {"–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "...", "°": " degrees ", "±": "+/-", "×": "x", "→": "->", " ": " "}
CLOSINGS = [
    r"^\s*ATTEST(?:ATION)?\b", r"^\s*SIGN-?OFF\b", r"^\s*SIGNATURE\b", r"\bPreliminary\s+Report\s+Electronically\s+Signed\b",
    r"\bFinal\s+Report\s+Electronically\s+Signed\b", r"\bReport\s+Electronically\s+Signed\b", r"\bElectronically\s+signed\s+by\b",
    r"\bE-?signed\s+by\b", r"\bDigitally\s+signed\s+by\b", r"\bSigned\s+by\s*[:\-]", r"\bDictated\s+by\s*[:\-]", r"\bTranscribed\s+by\s*[:\-]",
    r"\bI\s+have\s+(?:personally\s+)?(?:reviewed|examined|seen)\b", r"\bI\s+(?:was|have\s+been)\s+present\b",
    r"\bI\s+agree\s+with\s+the\s+(?:findings|above|report|plan)\b", r"\bAttending\s+(?:attestation|note|statement)\b",
    r"^\s*---\s*END\s+OF\s+REPORT\s*---\s*$", r"\bDate/Time\s+signed\b",
]
BODY = ["PROCEDURE", "INDICATIONS?", "HISTORY", r"CLINICAL\s+HISTORY", "TECHNIQUE", "FINDINGS", r"CORONARY\s+FINDINGS", "HEMODYNAMICS", "IMPRESSION", "COMPARISON", "EXAMINATION"]
PERSONAL = [
    (r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "[EMAIL]"), (r"\bhttps?://\S+", "[URL]"), (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]"), (r"(?i)\bMRN[:\s#]*\d+\b", "[MRN]"),
    (r"(?i)\bacc(?:ession)?(?:\s*[:#][:#\s]*[\w-]+|\s*[\w-]*\d[\w-]*)\b", "[ACCESSION]"),
    (r"(?i)\bDOB[:#\s]*\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b", "[DOB]"), (r"\(\d{3}\)\s*\d{3}[-.\s]?\d{4}\b|\(?\b\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b", "[PHONE]"),
    (r"\b[A-Z][A-Za-z.]+(?:\s+[A-Z][A-Za-z.]+){0,4}\s+(?:Medical Center|Hospital|Clinic|Health System|Medical Centre|General Hospital)\b", "[FACILITY]"),
]
# Abbreviations of reports in the order in which they are expanded; a later rule sees what an earlier one wrote
ABBREVIATIONS = [
    (r"\bLM\b", "left main"), (r"\bLAD\b", "left anterior descending"), (r"\bLCX\b", "left circumflex"), (r"\bRCA\b", "right coronary artery"),
    (r"\bPDA\b", "posterior descending artery"), (r"\bPLV\b", "posterior left ventricular"), (r"\bOM\d*\b", "obtuse marginal"), (r"\bD\d+\b", "diagonal branch"),
    (r"\bRI\b", "ramus intermedius"), (r"\bGDA\b", "gastroduodenal artery"), (r"\bRAS\b", "renal artery stenosis"), (r"\bSMA\b", "superior mesenteric artery"),
    (r"\bIMA\b", "inferior mesenteric artery"), (r"\bCFA\b", "common femoral artery"), (r"\bSFA\b", "superficial femoral artery"), (r"\bIVC\b", "inferior vena cava"),
    (r"\bSVC\b", "superior vena cava"), (r"\bAV\s+shunting\b", "arteriovenous shunting"), (r"\bLVEF\b", "left ventricular ejection fraction"),
    (r"\bLVEDP\b", "left ventricular end-diastolic pressure"), (r"\bLV\s+gram\b", "left ventriculogram"), (r"\bAo\b", "aorta"), (r"\bMAP\b", "mean arterial pressure"),
    (r"\bTIMI\b", "thrombolysis in myocardial infarction grade"), (r"\bHTN\b", "hypertension"), (r"\bDM2\b", "type 2 diabetes mellitus"), (r"\bDM\b", "diabetes mellitus"),
    (r"\bHLD\b", "hyperlipidemia"), (r"\bCAD\b", "coronary artery disease"), (r"\bCHF\b", "congestive heart failure"), (r"\bMI\b", "myocardial infarction"),
    (r"\bCP\b", "chest pain"), (r"\bSOB\b", "shortness of breath"), (r"\bHCC\b", "hepatocellular carcinoma"), (r"\bUGI\s+bleed\b", "upper gastrointestinal bleed"),
    (r"\bAKI\b", "acute kidney injury"), (r"\bESRD\b", "end-stage renal disease"), (r"\bNSTEMI\b", "non-ST-elevation myocardial infarction"),
    (r"\bSTEMI\b", "ST-elevation myocardial infarction"), (r"\bPE\b", "pulmonary embolism"), (r"\bDVT\b", "deep vein thrombosis"),
    (r"\bPCI\b", "percutaneous coronary intervention"), (r"\bCABG\b", "coronary artery bypass grafting"), (r"\bIR\b", "interventional radiology"),
    (r"\bDSA\b", "digital subtraction angiography"), (r"\bEGD\b", "esophagogastroduodenoscopy"), (r"\bMRA\b", "magnetic resonance angiography"),
    (r"\bTACE\b", "transarterial chemoembolization"), (r"\bTARE\b", "transarterial radioembolization"), (r"\bDES\b", "drug-eluting stent"), (r"\bBMS\b", "bare-metal stent"),
    (r"\bASA\b", "aspirin"), (r"\bEBL\b", "estimated blood loss"), (r"\bmGy\b", "milligray"), (r"\bcGycm", "centigray-cm"), (r"\bmmHg\b", "millimeters of mercury"),
    (r"(\d+)\s*French\b", "$1 French (catheter size)"), (r"(\d+)\s*F\b(?!\w)", "$1 French (catheter size)"), (r"\bSegment\s+([1-8])\b", "Couinaud liver segment $1"),
    (r"\bSeg\.?\s*([1-8])\b", "Couinaud liver segment $1"), (r"\bLV\b", "left ventricular"), (r"\bw/o\b", "without"), (r"\bw/(?=\s|$)", "with"), (r"\bh/o\b", "history of"),
    (r"\bs/p\b", "status post"), (r"\bp/w\b", "presenting with"), (r"\by/?o\b", "year old"), (r"\bpk-?yr\b", "pack-year"), (r"\bhx\b", "history"), (r"\bf/u\b", "follow up"),
    (r"\bwk(s)?\b", "week$1"), (r"\bqhs\b", "at bedtime"), (r"\bpt\b", "patient"),
]
# Headers that get a line of their own, lead-ins of generated reports
SECTIONS = ["PROCEDURE", "INDICATIONS", "HEMODYNAMICS", "CORONARY FINDINGS", "FINDINGS", "IMPRESSION", "PLAN", "HISTORY", "TECHNIQUE", "COMPARISON", "COMPLICATIONS"]
LEAD_IN = r"(?i)^(?:rephrased report|rewritten report|augmented report|report)\s*:\s*"
KEPT_HEADERS = ["VARIANT ANATOMY", "ANGIOGRAPHIC ENDPOINT", "VESSEL CATHETERIZED", "PROCEDURE"]


def chain(c: Column, *rules: tuple[str, str]) -> Column:
    """Regular-expression replacements one after the other."""
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return c


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def plain_characters(c: Column) -> Column:
    for a, b in REPLACED.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def mask_personal(c: Column) -> Column:
    return chain(c, *PERSONAL)


def cut_closing(c: Column) -> Column:
    """The text before its first closing phrase."""
    return F.rtrim(F.regexp_replace(c, "(?ims)(?:" + "|".join(CLOSINGS) + r").*\z", ""))


def from_body(c: Column) -> Column:
    """The text from its first body header, or all of it."""
    found = F.regexp_extract(c, r"(?ims)(^[ \t]*(?:" + "|".join(BODY) + r")\s*[:\-].*)\z", 1)
    return F.when(found == "", c).otherwise(F.ltrim(found))


def clean_lists(c: Column) -> Column:
    return chain(c, (r"(?m)^\s*[*•\-–—]+\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), (r"-{3,}.*?-{3,}", ""), ("[=_]{3,}", ""), (r"([!?.,;:])\1+", "$1"))


def collapse(c: Column) -> Column:
    return F.regexp_replace(chain(c, (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")), r"^\s+|\s+$", "")


def clean_report(c: Column) -> Column:
    return collapse(clean_lists(from_body(cut_closing(mask_personal(plain_characters(c))))))


def expand_abbreviations(c: Column) -> Column:
    """Abbreviations of any case written out, one rule after the other."""
    return chain(c, *(("(?i)" + pattern, by) for pattern, by in ABBREVIATIONS))


def section_headers(c: Column) -> Column:
    """Headers in capitals with a colon, and a blank line before each."""
    for h in SECTIONS:
        c = chain(c, (rf"(?imd)^\s*{h}\s*[:\-]?\s*$", f"{h}:"), (rf"(?imd)^\s*{h}\s*[:\-]\s*", f"{h}: "))
    return chain(c, (r"(?md)(?<!\n\n)^((?:" + "|".join(SECTIONS) + "):)", "\n$1"), (r"^\n+", ""))


def finished_report(c: Column) -> Column:
    """The whole cleaning chain: as clean_report, with abbreviations, headers and sentence case."""
    opened = expand_abbreviations(from_body(cut_closing(mask_personal(plain_characters(c)))))
    return collapse(lower_sentences(section_headers(collapse(clean_lists(opened)))))


def sliced_or_whole(c: Column, least: int = 100) -> Column:
    """The kept sections, or the whole text where they have fewer than `least` characters; null is empty."""
    text = F.coalesce(c, F.lit(""))
    cut = slice_sections(text)
    return F.when(F.length(cut) < least, text).otherwise(cut)


def plain_text(c: Column) -> Column:
    """Unix line ends, single blanks, at most one empty line, no white space at the ends; null is empty."""
    return strip(chain(F.coalesce(c, F.lit("")), (r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")))


def generated_text(c: Column) -> Column:
    """A model's text without a lead-in label and without a pair of quotes around all of it."""
    text = strip(F.regexp_replace(plain_text(c), LEAD_IN, ""))
    return strip(F.regexp_replace(text, r"(?s)^([\"'])(.*)\1$", "$2"))


def header_kept(h: Column) -> Column:
    u = F.upper(strip(h))
    return ~u.startswith("INDICATION") & (u.contains("FINDINGS") | u.contains("IMPRESSION") | u.isin(KEPT_HEADERS) | u.contains("ANGIOGRAPHY") | u.contains("AORTOGRAPHY"))


def slice_sections(c: Column) -> Column:
    """The lines under kept headers: each line looks back to its last header."""
    lines = F.split(F.regexp_replace(c, r"(?<!\n)(?=\b[A-Z][A-Z /\-()]{2,40}:)", "\n"), "\n")
    seen = F.aggregate(
        lines,
        F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("kept")),
        lambda s, line: _step(s, line),
        lambda s: F.array_join(s["kept"], "\n"),
    )
    kept = F.regexp_replace(seen, r"(?i)[^.]*(?:maximal sterile barrier|prepped and draped|time.?out was performed|informed consent)[^.]*\.\s*", "")
    return strip(F.regexp_replace(kept, r"\n{3,}", "\n\n"))


def _step(state: Column, line: Column) -> Column:
    header = F.regexp_extract(strip(line), r"^([A-Za-z][A-Za-z0-9 /\-()']{1,60}):", 1)
    on = F.when(header != "", header_kept(header)).otherwise(state["on"])
    return F.struct(on.alias("on"), F.when(on & (strip(line) != ""), F.concat(state["kept"], F.array(F.rtrim(line)))).otherwise(state["kept"]).alias("kept"))


def key_text(c: Column) -> Column:
    """`12345.0` as `12345`; blank as null."""
    return F.nullif(F.regexp_replace(strip(c), r"^(\d+)\.0$", "$1"), F.lit(""))


def uid_list(c: Column) -> Column:
    """UIDs of plain, quoted or bracketed comma lists."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"[()\[\]'\"]", ""), ","), strip), lambda x: x != "")


def tokens(c: Column, separators: str = r"[,;|]") -> Column:
    return F.filter(F.transform(F.split(c, separators), strip), lambda x: ~F.lower(x).isin("", "nan", "none", "null", "na"))


def stem(c: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(?i)\.dcm$", "")


def directory_name(c: Column) -> Column:
    return F.substring(chain(strip(c), (r"\s+", "_"), (r"[^A-Za-z0-9._-]", "_"), (r"^[_.]+|[_.]+$", "")), 1, 150)


def clean_sql(c: Column) -> Column:
    return strip(chain(c, (r"(?i)```(?:sqlite|sql)?\s*", "")))


def metric_value(c: Column) -> Column:
    """The number before a deviation or bracket."""
    return strip(F.get(F.split(F.replace(c, F.lit("%"), F.lit("")), r"[±(]"), F.lit(0))).try_cast("double")


def basename(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(c, r"/+$", ""), "/"), -1)


def parent(c: Column) -> Column:
    """The folder that a path lies in, null for a bare name."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, r"/+$", ""), r"^(.*)/[^/]*$", 1), F.lit(""))


def plain_uid(c: Column) -> Column:
    """A UID without zero-width characters, byte-order marks and white space around it."""
    return strip(F.translate(c, "\u200b\u200c\u200d\u2060\ufeff", ""))


def plain_value(c: Column, most: int = 2000) -> Column:
    """A header value as text: NA for none, an array joined by `;`, at most `most` characters."""
    return F.substring(F.coalesce(F.array_join(F.filter(c, lambda x: x.isNotNull()), ";"), F.lit("NA")), 1, most)


def tidy_architecture(c: Column) -> Column:
    """One space around +, none around / and -, one between words."""
    return strip(chain(c, (r"\s*\+\s*", " + "), (r"\s*([/-])\s*", "$1"), (r"\s+", " ")))


def lower_sentences(c: Column) -> Column:
    """Sentence case: words are lower-cased but those of two or more letters (A-Z) that are all capitals; tags in square brackets are in capitals.

    A word's first letter a-z is raised at the beginning of the text, after white space with a line break, and after white space that follows `.`, `!` or `?`.
    """
    lowered = lambda w: F.when(F.regexp_replace(w, "[^A-Za-z]", "").rlike("^[A-Z]{2,}$"), w).otherwise(F.lower(w))

    def cased(tokens: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            before, low = F.coalesce(F.get(tokens, i - 1), F.lit("")), lowered(w)
            starts = (i == 0) | ((i == 1) & before.rlike(r"(?U)^\s")) | before.contains("\n") | (before.rlike(r"(?U)^\s") & F.coalesce(F.get(tokens, i - 2), F.lit("")).rlike("[.!?]$"))
            return F.when(starts & low.rlike("^[a-z]"), F.concat(F.upper(F.substring(low, 1, 1)), low.substr(F.lit(2), F.length(low)))).otherwise(low)

        return F.array_join(F.transform(tokens, one), "")

    tag = r"\[[a-z_][a-z0-9_]*\]"
    raised = lambda pieces: F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^{tag}$"), F.upper(p)).otherwise(p)), "")
    once = lambda array, f: F.get(F.transform(F.array(array), f), F.lit(0))  # noqa: E731  the array is made once, not for each of its elements
    return once(F.split(once(F.regexp_extract_all(c, F.lit(r"(?U)\s+|\S+"), F.lit(0)), cased), rf"(?={tag})|(?<=\])"), raised)
