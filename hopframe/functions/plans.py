"""English step text to query plans (arrays of operations), as native expressions.

A step's relation comes from the first rule that matches; then the first template that matches gives the operation.
Steps that refer to an earlier one ([#k]) look values up backwards in "what other movies ... by [#k]" and project
them forward otherwise.
"""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Relation by keyword, in order; the first match holds.
RELATIONS = [
    ("actor|actors|acted|act|starred|star|appeared|appear|played|cast|co-starred|co-star", "starred_actors"),
    ("director|directed|direct", "directed_by"),
    ("writer|writers|wrote|written|screenwriter|screenwriters|scriptwriter|scriptwriters|screenplay", "written_by"),
    ("genre|genres|type|types", "has_genre"),
    ("language|languages", "in_language"),
    ("release year|release years|released|release date|release dates|year|years", "release_year"),
    ("tags?", "has_tags"),
    ("imdb rating", "has_imdb_rating"),
    ("imdb votes", "has_imdb_votes"),
]

REVERSE, FORWARD, PROJECT = "MOVIES_WITH_VALUE", "VALUES_OF_MOVIE", "PROJECT_VALUES_FROM_MOVIES"

# Step templates in order (pattern with the entity as group 1, operation, relation; None: the inferred one).
TEMPLATES = [
    (r"^what\s+(?:movies|films).*\b(?:did|does|was|were)\b\s+(.+?)\s+(?:an\s+)?(?:actor\s+)?(?:act|acted|star|starred|appear|appeared).*\bin\??$", REVERSE, None),
    (r"^what\s+(?:movies|films).*\bwas\b\s+(.+?)\s+\bin\??$", REVERSE, "starred_actors"),
    (r"^what\s+(?:movies|films).*\b(?:did|does)\b\s+(.+?)\s+\b(?:direct|directed|write|wrote)\b.*\??$", REVERSE, None),
    (r"^who\s+directed\s+(.+?)\??$", FORWARD, "directed_by"),
    (r"^who\s+(?:wrote|is\s+the\s+writer\s+of|is\s+the\s+screenwriter\s+of|is\s+listed\s+as\s+screenwriter\s+of)\s+(.+?)\??$", FORWARD, "written_by"),
    (r"^who\s+(?:starred|acted|appeared)\s+in\s+(.+?)\??$", FORWARD, "starred_actors"),
    (r"^who\s+(?:are|were)\s+the\s+(?:actors|actor|cast)\s+in\s+(.+?)\??$", FORWARD, "starred_actors"),
    (r"^what\s+(?:actors|actor|cast)\s+(?:were|was|are)\s+in\s+(.+?)\??$", FORWARD, "starred_actors"),
    (r"^who\s+is\s+the\s+.+?\s+of\s+(.+?)\??$", FORWARD, None),
    (r"^what\s+movies?\s+was\s+(.+?)\s+directed\s+by\??$", FORWARD, "directed_by"),
    (r"^what\s+movies?\s+was\s+(.+?)\s+(?:screenplay\s+)?written\s+by\??$", FORWARD, "written_by"),
]
OTHERS_BY = r"(?i)^what\s+other\s+(?:movies|films).*\bby\b\s+\[#(\d+)\]\??$"


def infer_relation(step: Column) -> Column:
    """The relation of the first rule that matches, null without one."""
    return F.coalesce(*(F.when(step.rlike(rf"(?i)\b(?:{words})\b"), F.lit(name)) for words, name in RELATIONS))


def step_op(step: Column) -> Column:
    """struct(op, relation, entity, ref_step, error) of one normalized step."""
    relation = infer_relation(step)

    def make(op=None, rel=None, entity=None, ref=None, error=None) -> Column:
        none = lambda t: F.lit(None).cast(t)
        return F.struct(
            (F.lit(op) if op else none("string")).alias("op"),
            (rel if rel is not None else none("string")).alias("relation"),
            (entity if entity is not None else none("string")).alias("entity"),
            (ref if ref is not None else none("int")).alias("ref_step"),
            (F.lit(error) if error else none("string")).alias("error"),
        )

    first_ref = F.regexp_extract(step, r"\[#(\d+)\]", 1)
    out = F.when(relation.isNull(), make(error="cannot_infer_relation"))
    out = out.when(step.rlike(OTHERS_BY), make(REVERSE, relation, ref=F.regexp_extract(step, OTHERS_BY, 1).try_cast("int")))
    out = out.when(first_ref != "", make(PROJECT, relation, ref=first_ref.try_cast("int")))
    for pattern, op, fixed in TEMPLATES:
        p = "(?i)" + pattern
        entity = F.regexp_replace(F.trim(F.regexp_extract(step, p, 1)), r"\?+$", "")
        out = out.when(step.rlike(p), make(op, F.lit(fixed) if fixed else relation, entity=entity))
    return out.otherwise(make(error="unsupported_step_template"))


def compile_steps(decomposition: Column) -> Column:
    """array of step_op structs of the non-blank lines."""
    return F.transform(T.lines(decomposition), lambda s: step_op(T.normalize_step_line(s)))


def compile_error(ops: Column) -> Column:
    """The first step's error, null if all compile."""
    return F.get(F.filter(F.transform(ops, lambda o: o["error"]), lambda e: e.isNotNull()), F.lit(0))


def substitute(text: Column, answers: Column, accept_bare: bool = True) -> Column:
    """struct(text, resolved, unresolved): [#k] (and bare #k) replaced by answers[k - 1] where that isn't blank.

    One pass from left to right; what is put in isn't looked at again. "[#k" without its bracket is left and unresolved."""
    ref = r"\[#\d+\]|\[#\d+" + (r"|(?<![\[\w#])#\d+(?!\w)" if accept_bare else "")
    refs = F.regexp_extract_all(text, F.lit(f"({ref})"), F.lit(1))
    number = lambda r: F.regexp_extract(r, r"(\d+)", 1).try_cast("int")
    answer = lambda r: F.nullif(F.trim(F.get(answers, number(r) - 1)), F.lit(""))
    whole = lambda r: ~F.startswith(r, F.lit("[")) | F.endswith(r, F.lit("]"))
    known = lambda r: whole(r) & answer(r).isNotNull()

    def put(state: Column, r: Column) -> Column:
        rest = state["rest"]
        cut = F.position(r, rest)
        before = F.substr(rest, F.lit(1), cut - 1)
        after = F.substr(rest, cut + F.length(r))
        return F.struct(F.concat(state["done"], before, F.when(known(r), answer(r)).otherwise(r)).alias("done"), after.alias("rest"))

    folded = F.aggregate(refs, F.struct(F.lit("").alias("done"), text.alias("rest")), put, lambda s: F.concat(s["done"], s["rest"]))
    return F.struct(
        folded.alias("text"),
        F.transform(F.filter(refs, known), number).alias("resolved"),
        F.transform(F.filter(refs, lambda r: ~known(r)), number).alias("unresolved"),
    )


def step_flags(answer: Column, unresolved: Column, error: Column, executed: Column) -> Column:
    """Failure flags of an executed step, in fixed order."""
    blank = F.trim(F.coalesce(answer, F.lit(""))) == ""
    failed = F.coalesce(F.length(error) > 0, F.lit(False))
    flags = F.array(
        F.when(F.size(unresolved) > 0, F.lit("broken_reference")),
        F.when(failed, F.lit("generation_error")),
        F.when(~failed & executed & blank, F.lit("empty_answer")),
        F.when(~executed, F.lit("not_executed")),
    )
    return F.filter(flags, lambda f: f.isNotNull())


NUMBER_WORDS = ["ONE", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "NINE"]  # fixed values


def hop_labels(hop: int) -> list[str]:
    word = NUMBER_WORDS[hop - 1].lower() if 1 <= hop <= 9 else None
    return [f"{hop}-hop", f"{hop} hop", *([f"{word}-hop", f"{word} hop"] if word else [])]


def parse_hop(response: Column, hops: list[int], default: int, answer_regex: str | None = None, truncate_at: list[str] | None = None, fallback: str = "hop_words") -> Column:
    """struct(hop, parsed): the answer pattern's number, else the first digit among hops, else a label, else default."""
    clean = T.post_process(response, True, truncate_at)
    tries = []
    if answer_regex:
        tries.append(F.nullif(F.regexp_extract(clean, answer_regex, 1), F.lit("")).try_cast("int"))
    tries.append(F.nullif(F.regexp_extract(clean, f"([{''.join(map(str, hops))}])", 1), F.lit("")).try_cast("int"))
    if fallback == "hop_words":
        low = F.lower(clean)
        for h in hops:
            found = F.lit(False)
            for w in hop_labels(h):
                found = found | F.contains(low, F.lit(w))
            tries.append(F.when(found, F.lit(h)))
    elif fallback == "number_words":
        up = F.upper(clean)
        tries += [F.when(F.contains(up, F.lit(w)), F.lit(i)) for i, w in enumerate(NUMBER_WORDS, 1) if i in hops]
    else:
        raise ValueError(f"unknown fallback labels: {fallback}")
    found = F.coalesce(*tries)
    return F.struct(F.coalesce(found, F.lit(default)).alias("hop"), found.isNotNull().alias("parsed"))


# ---- prompts ----


def fill(template: str | Column, **slots: Column) -> Column:
    """{slot} replaced by each column; slots that the template lacks don't matter."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def split_chat(template: str, marker: str) -> tuple[str, str]:
    if marker not in template:
        raise ValueError(f"the template lacks {marker!r}")
    a, b = template.split(marker, 1)
    return a.strip(), b.strip()


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(template: str, marker: str, **slots: Column) -> Column:
    """array<struct<role, content>> of the two halves of a template, both filled in."""
    system, user = split_chat(template, marker)
    return F.array(message("system", fill(system, **slots)), message("user", fill(user, **slots)))


def reader_prompt(template: str, style: str, marker: str, **slots: Column) -> Column:
    """A reader's messages, whose slots must all stand where they are filled in. "chat": the half above the marker is the
    system's and stays as it is, the user's half is filled in. "plain": one user message, both halves with a blank line
    between them (a template without the marker as it is), filled in as a whole."""
    if style not in ("chat", "plain"):
        raise ValueError(f"prompts are chat or plain, not {style}")
    halves = split_chat(template, marker) if style == "chat" or marker in template else (template,)
    filled = halves[1] if style == "chat" else "\n\n".join(halves)
    require_slots(filled, *slots)
    return F.array(*([message("system", F.lit(halves[0]))] if style == "chat" else []), message("user", fill(filled, **slots)))


def require_slots(template: str, *slots: str) -> None:
    """Every slot is in the template."""
    if lacking := [s for s in slots if "{" + s + "}" not in template]:
        raise ValueError(f"the template lacks {lacking}")


def render_examples(examples: Column, form: str = "Question: {question}\nDecomposition:\n{decomposition}") -> Column:
    """Blank-line separated examples of array<struct<question, decomposition>>."""
    return F.array_join(F.transform(examples, lambda e: fill(form, question=e["question"], decomposition=e["decomposition"])), "\n\n")


def render_context(paragraphs: Column, form: str = "[{idx}] {title}\n{text}", separator: str = "\n\n") -> Column:
    """array<struct<idx, title, paragraph_text>> as text; a missing idx is the place from 1."""
    return F.array_join(F.transform(paragraphs, lambda p, i: fill(form, idx=F.coalesce(p["idx"].cast("long"), (i + 1).cast("long")), title=F.coalesce(p["title"], F.lit("")), text=F.coalesce(p["paragraph_text"], F.lit("")))), separator)


# What makes a template line speak of the hop count, where a line's clauses end, what makes a clause say
# something.
HOP_LINE = r"(?i)\{hop_count\}|hop[\s_-]*count"
CLAUSE_END = r"(?i)[.;:,]|\band\b|\bbut\b"
SAYING = r"[A-Za-z]{2,}"


def hop_line_column(template: Column) -> Column:
    """The lines that speak of the hop count."""
    return F.filter(F.split(template, T.LINE_END), lambda x: x.rlike(HOP_LINE))


def mixed_hop_line_column(template: Column) -> Column:
    """Those of them that have a clause with a word and without the hop count."""
    other = lambda clause: clause.rlike(SAYING) & ~clause.rlike(HOP_LINE)
    return F.filter(hop_line_column(template), lambda x: F.exists(F.split(x, CLAUSE_END), other))


def unguided_column(template: Column) -> Column:
    """The template without those lines and their ends; null where a line is mixed."""
    out = F.regexp_replace(template, r"(?im)^[^\r\n]*(?:\{hop_count\}|hop[\s_-]*count)[^\r\n]*(?:\r\n|\n|\r|\z)", "")
    return F.when(F.size(mixed_hop_line_column(template)) == 0, out)


def unguided_status(guided: Column, given: Column) -> Column:
    """What there is to say of a pair of templates, of which the second should be the first without its lines on the hop
    count, to the byte: "same", "mixed" (such a line says something else too), "different" or "missing"."""
    plain = unguided_column(guided)
    return F.when(guided.isNull() | given.isNull(), "missing").when(plain.isNull(), "mixed").when(plain == given, "same").otherwise("different")
