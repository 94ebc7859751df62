"""Text functions on Columns: guardrails for generated prose (TX), titles, search terms, chunk filters."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

# What generated prose must not begin with, hold, or repeat, as given by the rules' source.
BAD_STARTS = ("we need", "let me", "i need", "the user", "let's", "sure,", "here is", "here's", "rewrite", "input:", "certainly")
GARBAGE = (
    "<|", "#include", ".map(", "Array.", "NSAttributed", "dp-thinking", "dp-answer", "---------", "####", ".com/", "http://", "https://", "%20", "<math>", "^{", ".rseqtable", "{\\",
)
PROSE_STOPWORDS = (
    "the a an and or of in is are was were to for with that this it as at be by on not from but its their which have has been also both more than into over such these".split()
)
COT_LABEL = r"(?i)(?:^|\n)\s*(?:think|say|body|tax|ok|end|also|but|note|for\s+force)\s*[:.]\s*"
COT_END = (
    r"(?im)(?:let\s+(?:final|me\s+output|the\s+final)|final\s+(?:output|answer|sentence)[:\s]"
    r"|ok(?:ay)?\s*[,:.]\s*(?:sent|here|so|final|output|give|the)|output\s+is\s+body|i\s+must\s+output|\bsent\.\s*$)"
)
ACTION_WORDS = (
    "drive drives determine determines predict predicts control controls govern governs increase increases reduce reduces dominate dominates shape shapes define defines explain explains amplify amplifies are is".split()
)
BAD_DOMAIN_TERMS = ("column", "dataset", "uploaded", "paper", "title", "infer", "unknown")
SEARCH_STOPWORDS = (
    "a an and as avg average by col column conc concentration data dose final for from id in initial input level mean mg ml ng of output pct percent rate result sample sec time to total ug value with".split()
)
PROCESS_RULES = (
    (("plasma", "discharge", "voltage", "kv"), "plasma treatment"),
    (("uv", "lamp", "fluence", "photolysis"), "photolysis"),
    (("ozone", "o3"), "ozonation"),
    (("sonication", "ultrasound", "acoustic"), "sonochemical treatment"),
    (("electrochemical", "electrolysis", "current", "electrode"), "electrochemical treatment"),
    (("thermal", "temperature", "pyrolysis", "incineration"), "thermal treatment"),
    (("catalyst", "photocatalyst", "catalytic"), "catalysis"),
    (("adsorption", "sorbent", "carbon", "resin"), "adsorption"),
    (("peroxide", "h2o2", "oxidation", "oxidant"), "oxidation"),
)
DEGRADATION_HINTS = ("removal", "degradation", "decay", "yield")
WATER_HINTS = ("water", "solution", "aqueous", "ph", "conductivity")
UNIT_TOKENS = ("mg_l", "ug_l", "ng_l", "mg", "ug", "ng", "ml", "min", "hours", "pct")


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _share(count: Column, total: Column) -> Column:
    return F.try_divide(count.cast("double"), total.cast("double"))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _core(word: Column) -> Column:
    return F.regexp_replace(word, r"""^[.,!?;:()\[\]"']+|[.,!?;:()\[\]"']+$""", "")


def _longest_run(sorted_words: Column) -> Column:
    """How often the most frequent of sorted strings is there; 0 of none."""
    kind = "struct<word:string,run:int,best:int>"

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["word"] == x, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("word"), run.alias("run"), F.greatest(s["best"], run).alias("best")).cast(kind)

    start = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("best")).cast(kind)
    return F.coalesce(F.aggregate(sorted_words, start, step, lambda s: s["best"]), F.lit(0))


def sentence_marks(text: Column) -> Column:
    """What is_clean_sentence judges by: alpha (share of letters and blanks) and sound (all else). A column of it serves several judgements."""
    n, low, w = F.length(text), F.lower(text), words(text)
    total = F.size(w)
    significant = F.filter(F.transform(w, lambda x: F.lower(_core(x))), lambda x: (F.length(x) >= 4) & ~F.array_contains(_array(PROSE_STOPWORDS), x))
    top = _longest_run(F.array_sort(significant))
    starts = F.lit(False)
    for s in BAD_STARTS:
        starts = starts | low.startswith(s)
    holds = F.lit(False)
    for s in GARBAGE:
        holds = holds | text.contains(s)
    sound = (
        (n >= 15)
        & (_share(F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")), n) <= 0.015)
        & ~starts
        & ~holds
        & ~text.rlike(r"(?U)[^\w\s]{3,}")
        & (total >= 6)
        & (_share(F.size(F.filter(w, lambda x: _core(x).rlike(r"[*|\\@#{}_%]"))), total) <= 0.15)
        & (_share(top, total) <= 0.20)
    )
    return F.struct(_share(F.length(F.regexp_replace(text, r"[^\p{L} ]", "")), n).alias("alpha"), sound.alias("sound"))


def is_clean_sentence(text: Column, alpha_min: float = 0.65, marks: Column | None = None) -> Column:
    """TX2: prose that shows no sign of leaked reasoning, markup, noise or loops. Null is not clean.

    alpha_min: least share of letters and blanks (the browser's twin of the rule, TX8, takes 0.60). marks: a column of sentence_marks(text).
    """
    marks = sentence_marks(text) if marks is None else marks
    return F.coalesce((marks["alpha"] >= alpha_min) & marks["sound"], F.lit(False))


def is_clean_paragraph(text: Column, marks: Column | None = None) -> Column:
    """TX3: a clean sentence with two colons at most, no reasoning label and no sentence of one or two words."""
    pieces = F.transform(F.split(text, r"(?<=[.!])\s+"), lambda p: F.trim(p))
    short = F.exists(pieces, lambda p: p.endswith(".") & F.size(words(p)).between(1, 2))
    return is_clean_sentence(text, marks=marks) & (F.regexp_count(text, F.lit(":")) <= 2) & ~text.rlike(COT_LABEL) & ~short


def is_clean_title(text: Column) -> Column:
    """TX4: 5 to 12 words, a capital first, no question, no inner full stop, no repeated trigram, a word of action."""
    w = F.split(F.trim(text), r"\s+")
    low = F.transform(w, F.lower)
    n = F.size(w)
    trigrams = F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.array_join(F.slice(low, i, 3), " "))).otherwise(F.array().cast("array<string>"))
    acts = F.exists(low, lambda x: F.array_contains(_array(ACTION_WORDS), x) | F.array_contains(_array(ACTION_WORDS), F.regexp_replace(x, "s+$", "")))
    good = text.rlike(r"^\p{Lu}") & n.between(5, 12) & ~text.contains("?") & ~F.regexp_replace(text, r"\.+$", "").contains(".") & (F.size(trigrams) == F.size(F.array_distinct(trigrams))) & acts
    return F.coalesce(good, F.lit(False))


def strip_label(text: Column) -> Column:
    """TX5: text without a leading output:, title: or answer:, or colons."""
    cut = F.regexp_replace(text, r"(?i)^(?:output|title|answer):", "")
    return F.when(F.lower(text).rlike("^(?:output|title|answer):"), F.trim(cut)).otherwise(F.trim(F.regexp_replace(text, "^:+", "")))


def strip_thinking(text: Column) -> Column:
    """TX1: the answer behind thinking blocks and markers; of its sentences, the last two long ones that bear no label."""
    bare = F.trim(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))
    tail = F.trim(F.regexp_replace(bare, "(?s)^.*" + COT_END.replace("(?im)", "(?im:").replace(r"\bsent\.\s*$)", r"\bsent\.\s*$))"), ""))
    body = F.when(bare.rlike(COT_END) & (F.length(tail) > 20), tail).otherwise(bare)
    parts = F.transform(F.split(body, r"\.(?:\s+(?=[A-Z])|(?=[A-Z]))"), lambda p: F.trim(p))
    real = F.filter(parts, lambda p: (F.size(words(p)) >= 8) & ~p.rlike(COT_LABEL) & p.rlike(r"^\p{Lu}"))
    # one pass over the sentences: what they are made of is not worked out again for each
    once = lambda kept, p: F.when(F.exists(kept, lambda q: F.lower(q) == F.lower(p)), kept).otherwise(F.array_append(kept, p))
    last_two = lambda kept: F.array_join(F.slice(kept, F.greatest(F.size(kept) - 1, F.lit(1)), 2), ". ")
    answer = F.aggregate(real, F.array().cast("array<string>"), once, lambda kept: F.when(F.size(kept) > 0, F.concat(F.regexp_replace(last_two(kept), r"\.$", ""), F.lit("."))))
    return F.coalesce(answer, body)


def is_clean_domain(text: Column) -> Column:
    """TX7: a domain label of 2 to 15 words, letters mostly, without CJK signs or banned terms."""
    line = F.element_at(F.split(F.trim(text), r"\r?\n"), -1)
    label = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.trim(line), r"(?i)^(output|answer|domain|context|result)\s*[:\-]\s*", "")), "^[\"']+|[\"']+$", ""), r"\.+$", "")
    label = F.regexp_replace(label, r"\s+", " ")
    banned = F.lit(False)
    for t in BAD_DOMAIN_TERMS:
        banned = banned | F.lower(label).contains(t)
    good = (
        (F.length(label) > 0)
        & ~label.rlike("[一-鿿぀-ヿ]")
        & F.size(words(label)).between(2, 15)
        & ~banned
        & ~label.contains("?")
        & ~label.rlike(r"[*|\\@#{}_%<>]")
        & (_share(F.length(F.regexp_replace(label, r"[^\p{L}\p{Nd} /\-&]", "")), F.length(label)) >= 0.80)
    )
    return F.coalesce(good, F.lit(False))


def pick_title(text: Column, fallback: Column) -> Column:
    """The longest of the first five lines with text, 200 characters at most; the fallback if it has 10 or fewer."""
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 5)
    longest = F.aggregate(lines, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return F.when(F.length(longest) > 10, F.substring(longest, 1, 200)).otherwise(fallback)


def normal_title(text: Column) -> Column:
    """Lower case, without signs, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\w\s]", ""), r"\s+", " "))


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def humanize(name: Column) -> Column:
    """A column's name as words, without units."""
    pattern = r"(?i)\b(?:" + "|".join(u.replace("_", " ") for u in UNIT_TOKENS) + r")\b"
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "_", " "), pattern, ""), r"\s+", " "))


def keyword_terms(text: Column, limit: int = 10) -> Column:
    """Distinct words of three or more signs, in order, without the stopwords."""
    found = F.regexp_extract_all(F.regexp_replace(F.lower(text), "_", " "), F.lit(r"[a-z][a-z0-9]{2,}"), 0)
    return F.slice(F.filter(F.array_distinct(found), lambda t: ~F.array_contains(_array(SEARCH_STOPWORDS), t)), 1, limit)


def process_terms(text: Column) -> Column:
    """Process names that the words of a text hint at."""
    low = F.lower(text)
    hits = []
    for needles, term in PROCESS_RULES:
        hit = F.lit(False)
        for n in needles:
            hit = hit | low.contains(n)
        hits.append(F.when(hit, F.lit(term)))
    return F.filter(F.array(*hits), lambda t: t.isNotNull())


def search_query(text: Column) -> Column:
    """Keyword terms, process terms and hints as one query."""
    low = F.lower(text)
    any_of = lambda hints, term: F.when(F.array_max(F.array(*[low.contains(h) for h in hints])), F.array(F.lit(term))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.array_distinct(F.concat(keyword_terms(text), process_terms(text), any_of(DEGRADATION_HINTS, "degradation"), any_of(WATER_HINTS, "water treatment"))), " ")


def truncate_references(text: Column) -> Column:
    """FL14: a text up to its first line that heads a list of references."""
    return F.element_at(F.split(text, r"(?i)\n(?:References|Bibliography|Works\s+Cited)\s*\n", 2), 1)


def is_reference_chunk(text: Column) -> Column:
    """FL15: a chunk that looks like a list of references."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r]"), lambda x: F.trim(x) != "")
    et_al = F.regexp_count(text, F.lit(r"(?i)\bet\s+al\."))
    author_year = F.regexp_count(text, F.lit(r"\([A-Z][a-z]+(?:\s+et\s+al\.)?,\s*\d{4}\)"))
    doi = F.regexp_count(text, F.lit(r"(?i)(?:doi:|https?://doi\.org/)"))
    nums = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1), lambda x: x.try_cast("long"))
    steps = F.zip_with(F.slice(nums, 2, F.greatest(F.size(nums) - 1, F.lit(0))), F.slice(nums, 1, F.greatest(F.size(nums) - 1, F.lit(0))), lambda a, b: a - b == 1)
    sequential = (F.size(nums) >= 5) & F.forall(steps, lambda x: x)
    short = _share(F.size(F.filter(lines, lambda x: F.length(F.trim(x)) < 80)), F.size(lines))
    listed = (et_al > 6) | sequential | (doi >= 3) | ((short > 0.60) & ((et_al > 3) | (author_year > 3) | (doi > 1)))
    return F.coalesce((F.size(lines) > 0) & listed, F.lit(False))


def stars(p: Column) -> Column:
    """Marks of significance."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def score_level(score: Column) -> Column:
    return F.when(score >= 0.9, "excellent").when(score >= 0.75, "strong").when(score >= 0.6, "moderate").when(score >= 0.4, "weak").otherwise("poor")


def effect_size_label(eta2: Column) -> Column:
    return F.when(eta2 >= 0.14, "large").when(eta2 >= 0.06, "medium").when(eta2 >= 0.01, "small").otherwise("negligible")


# Acronyms that stay in capitals, units that end a name, and what a title says when nothing is known (TX6).
ACRONYMS = ("ph", "uv", "ntp", "cap")
UNIT_ENDS = r"(?i)\s*(mg[_\s]l|ug[_\s]l|ng[_\s]l|mg[_\s]kg|ppm|ppb|pct|percent|min|sec|hrs?|degc|celsius)\s*$"
NO_TITLE = "Key Predictors Identified for Degradation Outcome"


def plain_name(name: Column) -> Column:
    """A column's name in plain words, without a unit at its end, known acronyms in capitals."""
    label = F.trim(F.regexp_replace(F.regexp_replace(name, "_", " "), UNIT_ENDS, ""))
    return F.array_join(F.transform(words(label), lambda w: F.when(F.array_contains(_array(ACRONYMS), F.lower(w)), F.upper(w)).otherwise(w)), " ")


def title_case(text: Column) -> Column:
    """Every run of letters with a capital first and small ones after."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), 0), F.initcap), "")


def fixed(x: Column, digits: int) -> Column:
    """A number with so many digits after the point, as C and Python write it: what the double holds is rounded (half to even), not its shortest decimal form."""
    plain = F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * digits if digits else "0"))
    # Java takes the shortest form where a 5 is the first digit and the first to go
    half, unit = 0.5 * 10.0**-digits, f"{10.0**-digits:.{digits}f}"
    small = F.when(F.abs(x) > half if Fraction(half) <= Fraction(1, 2 * 10**digits) else F.abs(x) >= half, unit).otherwise(f"{0:.{digits}f}")
    signed = F.concat(F.when((x < 0) | x.cast("string").startswith("-"), "-").otherwise(""), small)
    return F.when(x.isNull(), "null").when(F.abs(x) < 10.0**-digits, signed).when(F.abs(x) < 1e15, plain).otherwise(F.format_string(f"%.{digits}f", x.cast("double")))


def fallback_title(significant: Column, description: Column) -> Column:
    """TX6: a title from a model's first two significant variables and the outcome that "predict ... in regime" names."""
    outcome = title_case(plain_name(F.trim(F.regexp_extract(F.coalesce(description, F.lit("")), r"(?i)predict\s+(.+?)\s+in\s+regime", 1))))
    names = F.array_join(F.transform(F.slice(F.coalesce(significant, F.array().cast("array<string>")), 1, 2), lambda v: title_case(plain_name(v))), " and ")
    some, known = F.coalesce(F.size(significant) > 0, F.lit(False)), outcome != ""
    return F.when(some & known, F.concat(names, F.lit(" Drive "), outcome)).when(some, F.concat(names, F.lit(" Are Key Predictors"))).when(known, F.concat(F.lit("Multiple Factors Drive "), outcome)).otherwise(F.lit(NO_TITLE))


def fallback_rationale(significant: Column, coefficients: Column, r_squared: Column, adjusted: Column, passed: Column, citations: Column) -> Column:
    """TX6: a rationale from a model's numbers: up to five significant variables with their coefficients, the fit, whether it was validated, two titles."""
    known = F.filter(F.slice(F.coalesce(significant, F.array().cast("array<string>")), 1, 5), lambda v: F.try_element_at(coefficients, v).isNotNull())
    sign = lambda v: F.concat(v, F.lit(" ("), F.when(F.try_element_at(coefficients, v) >= 0, "+").otherwise(""), fixed(F.try_element_at(coefficients, v), 3), F.lit(")"))
    first = F.concat(F.lit("The strongest statistical signal involves "), F.array_join(F.transform(known, sign), ", "), F.lit(", suggesting these predictors align most closely with the fitted response. "))
    fit = F.format_string("In-sample fit is moderate (R²=%s, adj. R²=%s) and validation %s.", fixed(r_squared, 3), fixed(adjusted, 3), F.when(passed, "passed").otherwise("did not fully pass"))
    titles = F.array_join(F.transform(F.slice(F.coalesce(citations, F.array().cast("array<string>")), 1, 2), lambda t: F.substring(t, 1, 120)), "; ")
    return F.concat(F.when(F.size(known) > 0, first).otherwise(""), fit, F.when(F.coalesce(F.size(citations) > 0, F.lit(False)), F.concat(F.lit(" Corpus matches include: "), titles, F.lit("."))).otherwise(""))


def fallback_summary(experiments: Column, observations: Column, group: Column, rounds: Column, converged: Column, score: Column, effects: Column, responses: Column, key_variables: Column, sources: Column, system: str = "The system") -> Column:
    """TX6: a report's summary from its numbers."""
    status = F.when(converged, "converged").otherwise("reached maximum rounds")
    text = F.format_string(
        f"{system} analyzed %d experiments (%d observations) from a %s dataset across %d rounds of autonomous hypothesis testing. The pipeline %s with a match score of %s. %d statistically significant parameter effects were identified across %d response variables. ",
        experiments, observations, group, rounds, status, fixed(score, 2), effects, responses,
    )
    keys = F.when(F.coalesce(F.size(key_variables) > 0, F.lit(False)), F.concat(F.lit("Key variables: "), F.array_join(key_variables, ", "), F.lit(". "))).otherwise("")
    return F.concat(text, keys, F.format_string("Results were grounded against %d literature sources.", sources))


def fallback_finding(variable: Column, direction: Column, outputs: Column, score: Column) -> Column:
    """TX6: what a variable's effects on several outputs have in common."""
    where = F.when(F.coalesce(F.size(outputs) > 0, F.lit(False)), F.array_join(outputs, ", ")).otherwise("the outcome")
    return F.concat(variable, F.lit(" showed a "), direction, F.lit(" and statistically significant effect on "), where, F.format_string(", consistent across %s%% of tested outputs.", fixed(score * 100, 0)))
