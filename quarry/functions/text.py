"""Text functions as Column expressions: cleaning, sentences, headings, tokens, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Heading (lower case) -> section, and patterns whose results are part of the data model.
SECTIONS = {
    "abstract": "ABSTRACT", "summary": "ABSTRACT", "introduction": "INTRODUCTION", "background": "BACKGROUND", "methods": "METHODS", "materials and methods": "METHODS",
    "materials & methods": "METHODS", "methodology": "METHODS", "experimental procedures": "METHODS", "results": "RESULTS", "discussion": "DISCUSSION", "conclusion": "CONCLUSION",
    "conclusions": "CONCLUSION", "references": "REFERENCES", "bibliography": "REFERENCES", "acknowledgments": "ACKNOWLEDGMENTS", "acknowledgements": "ACKNOWLEDGMENTS",
    "supplementary information": "SUPPLEMENTARY", "supplementary": "SUPPLEMENTARY", "appendix": "SUPPLEMENTARY", "results and discussion": "RESULTS", "results & discussion": "RESULTS",
    "discussion and results": "RESULTS", "methods and materials": "METHODS", "methods & materials": "METHODS",
}
BOILERPLATE = (
    r"https?://\S+", r"\bdoi:\s*\S+", r"\bdoi\.org/\S+", r"\bdownloaded from\b.*", r"\borcid\b.*", r"\bpubmed\b.*", r"\bcrossref\b.*",
    r"\bfigure\s*\d+\b", r"\bfig\.\s*\d+\b", r"\b(accepted|received|revised)\b.*", r"\bpage\s*\d+\b",
)
NUMERIC_CITATION = r"\s*\d+\s*(?:[-–]\s*\d+)?\s*(?:,\s*\d+\s*(?:[-–]\s*\d+)?\s*)*"
TOKEN = r"[A-Za-z0-9_+\-Δ]+"
# End of fixed values.


def stripped(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    """Runs of white space as one blank, none at either end."""
    return stripped(F.regexp_replace(c, r"\s+", " "))


def words_of(c: Column) -> Column:
    return F.filter(F.split(collapsed(c), " "), lambda w: w != "")


def _letter(w: Column) -> Column:
    return w.rlike(r"^\p{L}$")


def looks_spaced(c: Column, least: int = 8, share: float = 0.55) -> Column:
    """Whether most tokens of a line are single letters."""
    w = words_of(F.coalesce(c, F.lit("")))
    return (F.size(w) >= least) & (F.size(F.filter(w, _letter)) / F.size(w) >= share)


def despaced(c: Column, least: int = 8, run: int = 5) -> Column:
    """Runs of at least five single letters become one word; then space at punctuation is put right."""
    w = words_of(c)
    empty = F.array().cast("array<string>")
    flushed = lambda a: F.concat(a["out"], F.when(F.size(a["run"]) >= run, F.array(F.array_join(a["run"], ""))).otherwise(a["run"]))
    start = F.struct(empty.alias("out"), empty.alias("run"))
    step = lambda a, t: F.when(_letter(t), F.struct(a["out"].alias("out"), F.concat(a["run"], F.array(t)).alias("run"))).otherwise(F.struct(F.concat(flushed(a), F.array(t)).alias("out"), empty.alias("run")))
    text = F.array_join(F.aggregate(w, start, step, flushed), " ")
    for pattern, to in ((r"\s+([,.;:!?])", "$1"), (r"\(\s+", "("), (r"\s+\)", ")"), (r"\s{2,}", " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.when(F.size(w) < least, c).otherwise(stripped(text))


def despaced_line(c: Column) -> Column:
    return F.when(looks_spaced(c), despaced(c)).otherwise(c)


def without_colons(c: Column) -> Column:
    return stripped(F.regexp_replace(stripped(c), r"^:+|:+$", ""))


def heading_core(c: Column) -> Column:
    """A line without its bullet, number or roman number."""
    for pattern in (r"^\s*[-•*]\s+", r"^\s*\d+(\.\d+)*[).:\-]\s+", r"(?i)^\s*[IVXLCDM]+[).:\-]\s+"):
        c = F.regexp_replace(stripped(c), pattern, "")
    return F.regexp_replace(without_colons(c), r"\s{2,}", " ")


def section_of(c: Column) -> Column:
    """The section that a heading opens; null for other lines."""
    names = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    line = stripped(F.coalesce(c, F.lit("")))
    low = F.lower(without_colons(heading_core(despaced_line(line))))
    spaced = stripped(F.regexp_replace(F.regexp_replace(low, r"\s*&\s*", " & "), r"\s{2,}", " "))
    bare = stripped(F.regexp_replace(spaced, r"[^\w\s&]", ""))
    return F.when((F.length(line) > 0) & (F.length(line) <= 160), F.coalesce(*[F.element_at(names, x) for x in (low, spaced, bare)]))


def sentences(c: Column) -> Column:
    """Sentences of a text: cut behind . ! ? before a capital, digit or bracket; not behind e.g., i.e. and et al."""
    t = F.regexp_replace(collapsed(F.coalesce(c, F.lit(""))), r"(?i)\b(e\.g|i\.e|et al)\.\s", "$1<DOT> ")
    return F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+(?=[A-Z0-9(])"), lambda p: stripped(F.replace(p, F.lit("<DOT>"), F.lit(".")))), lambda p: p != "")


def looks_like_references(c: Column) -> Column:
    """Whether a text is a list of references, by its heading, years, DOIs, links and journal words."""
    t = F.lower(stripped(F.coalesce(c, F.lit(""))))
    count = lambda p: F.regexp_count(t, F.lit(p))
    years, doi, etal, urls = count(r"\b(19|20)\d{2}\b"), count(r"\bdoi\b|10\.\d{4,9}/[-._;()/:a-z0-9]+"), count("et al"), count("https?://")
    journal = count(r"\b(journal|nature|science|cell|proc\.|proceedings|biorxiv|medrxiv)\b")
    return (
        (F.coalesce(c, F.lit("")) == "") | t.rlike(r"(^|\n)\s*(references|bibliography|literature cited)\s*($|\n)") | ((years >= 12) & ((doi >= 2) | (etal >= 5)))
        | (doi >= 4) | ((urls >= 4) & (years >= 8)) | ((years >= 15) & (journal >= 4))
    )


def search_tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({TOKEN})")), F.lower)


def clean_text(c: Column) -> Column:
    """Lower case without boilerplate, for embedding; some patterns reach to the text's end."""
    t = F.lower(F.regexp_replace(F.replace(c, F.lit("­"), F.lit("")), r"\s+", " "))
    for pattern in BOILERPLATE:
        t = F.regexp_replace(t, "(?i)" + pattern, " ")
    return collapsed(t)


def snippet(c: Column, most: int = 280) -> Column:
    t = collapsed(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most), r"\s+$", ""), F.lit(" ...")))


def without_numeric_citations(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(c, r"\[" + NUMERIC_CITATION + r"\]", ""), r"\(" + NUMERIC_CITATION + r"\)", "")
    return stripped(F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def title_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def paper_id_of(title: Column) -> Column:
    return F.regexp_replace(title, r"(?<=.)\.[^.]*$", "")


def chunk_id(paper: Column, kind: str, number: Column) -> Column:
    return F.concat(paper, F.lit(f"_{kind}_"), number.cast("string"))


def table_markdown(cells: Column) -> Column:
    """A table (rows of cells, null cells empty) as Markdown: the first row is the head, short rows are filled up."""
    rows = F.filter(F.transform(F.coalesce(cells, F.array().cast("array<array<string>>")), lambda r: F.transform(r, lambda x: stripped(F.coalesce(x, F.lit(""))))), lambda r: F.exists(r, lambda x: x != ""))
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalised(x: Column) -> Column:
    norm = F.sqrt(dot(x, x)) + F.lit(1e-12)
    return F.transform(x, lambda v: v.cast("double") / norm)


def softmax(x: Column, temperature: float) -> Column:
    top = F.array_max(x)
    raised = F.transform(x, lambda v: F.exp((v - top) / F.lit(max(temperature, 1e-9))))
    total = F.aggregate(raised, F.lit(0.0), lambda s, v: s + v) + F.lit(1e-12)
    return F.transform(raised, lambda v: v / total)


def within(k: Column | int, n: Column) -> Column:
    """k held between 1 and n."""
    return F.greatest(F.lit(1), F.least(F.lit(k) if isinstance(k, int) else k, n))
