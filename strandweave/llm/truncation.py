"""Problem 8: texts cut off by field limits or in mid-transfer.

Structural completeness check. A stack automaton reads each whole text: code fences and inline code, brackets, curly and straight quotes, strong
emphasis, markup elements, links and table rows that are still open at the end, broken multibyte sequences, escapes and entities, marks of a
cut ("[...]", "…"). What is open is cut, whatever is usual. An end that is none of
these is judged against the corpus: a closing line without a full stop is complete if the corpus closes that way often
enough; the last word of a list item, heading or link line must be known from other lines and not end lines far more seldom than words do;
a source whose paragraphs usually end without terminators gives no evidence by a missing one (told from paragraphs that are not a text's
last, so that cuts don't excuse themselves); a source whose longest texts pile up
at one length in characters or bytes has a field limit, and texts at it are cut.

The baselines are counted over all texts. Their tables are bounded: closing lines above a share of all texts (at most 1 / share
lines), and one row per source, which is joined under a salt.

Cases: null and empty texts are not cut (nothing is left to judge); a null source is a source of its own; repeated doc_ids with equal
text give one row; ties do not occur; an empty table gives no row; only doc_id, text and source are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.session import materialise

_TOKEN = re.compile(
    r"""(?P<gap>\n[ \t]*\n)|^[ \t]*(?P<fence>```|~~~)[^\n]*$|(?P<code>`+)|(?P<strong>\*\*)|(?P<end></[a-z][a-z0-9]*>)|(?P<tag><[a-z][a-z0-9]*(?:\s[^<>\n]*)?>)"""
    r"""|(?P<quote>")|(?P<single>(?<![\w'])'(?=[^\W\d_])|(?<=[\w.,!?;])'(?!\w))|(?P<bracket>[()\[\]{}“”«»])""",
    re.M,
)
_CLOSES = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
# Elements that HTML ends with a tag of their own.
_PAIRED = frozenset("a b i em strong code pre div span ul ol table tbody thead section article aside details summary blockquote h1 h2 h3 h4 h5 h6 sub sup kbd".split())
_ENTITY = re.compile(r"&(?:#\d*|#x[0-9a-f]*|am?|amp|apo?|apos|lt?|gt?|quo?|quot|nbs?|nbsp)$")
_PERCENT = re.compile(r"((?:%[0-9A-Fa-f]{2})+)(%[0-9A-Fa-f]?)?$")
_ESCAPE = re.compile(r"\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)$")
_MARK = re.compile(r"(?:\[\s*(?:\.\.\.|…)\s*\]|…)\s*$")
_TERMINATED = re.compile(r"""[.?!:;。！？]["'”’»)\]*_`]*$""")
_RUN = re.compile(r"[^\W_]+")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+\S")
_HEAD = re.compile(r"^#{1,6}\s+\S")
_POINTER = re.compile(r"^[A-Z][\w ]{2,20}: ")
_BREAK = re.compile(r"\n\s*\n")
_FENCE = re.compile(r"^[ \t]*(?:```|~~~)", re.M)
_SENTENCE = re.compile(r"""[.?!。！？]["'”’»)\]*_`]*\s""")

_OPEN = {"`": "open code", "*": "open emphasis", "<": "open markup", '"': "open quote", "'": "open quote", "“": "open quote", "«": "open quote"}
FEATURES = "doc_id {kind}, source string, n_chars long, n_bytes long, reason string, line string, word string"


def open_elements(text: str) -> list[str]:
    """What is open at the end of text, outermost first. Inline elements end with their paragraph, fences with a fence, markup elements with their tag.
    A bracket that the last paragraph but one leaves open counts too: what follows was added behind a cut."""
    outer: list[str] = []  # markup elements, across paragraphs
    stack: list[str] = []  # what ends with the paragraph
    torn: list[str] = []  # brackets that the paragraph before left open
    fence = ""
    for m in _TOKEN.finditer(text):
        kind, t = m.lastgroup, m.group()
        if fence:
            if kind == "fence" and m["fence"] == fence and t.strip() == fence:
                fence = ""
        elif kind == "fence":
            fence, stack = m["fence"], []
        elif kind == "gap":
            torn, stack = [t for t in stack if t in _CLOSES.values()], []
        elif stack and stack[-1][0] == "`":
            if t == stack[-1]:
                stack.pop()
        elif kind == "code":
            stack.append(t)
        elif kind == "tag":
            if t[1:-1].split()[0] in _PAIRED and not t.endswith("/>"):
                outer.append(t[1:-1].split()[0])
        elif kind == "end":
            if t[2:-1] in outer:
                while outer.pop() != t[2:-1]:
                    pass
        elif kind in ("quote", "strong", "single"):
            opens = kind != "single" or not text[m.start() - 1 : m.start()].strip(".,!?;").isalnum()
            if t in stack:
                while stack.pop() != t:
                    pass
            elif opens and not (kind == "quote" and text[m.start() - 1 : m.start()].isdigit()):  # not the sign of inches
                stack.append(t)
        elif t in _CLOSES:
            if _CLOSES[t] in stack:
                while stack.pop() != _CLOSES[t]:
                    pass
        else:
            stack.append(t)
    return [fence] if fence else [f"<{e}>" for e in outer] + (stack or torn)


def open_sequence(body: str) -> str | None:
    """A character, escape or entity that the end of body breaks off."""
    if body[-1] == "�" or 0xD800 <= ord(body[-1]) <= 0xDFFF:
        return "broken character"
    if (len(body) - len(body.rstrip("\\"))) % 2 or _ESCAPE.search(body):
        return "open escape"
    if _ENTITY.search(body):
        return "open entity"
    m = _PERCENT.search(body)
    if m:
        try:
            bytes.fromhex(m[1].replace("%", "")).decode("utf-8")
        except UnicodeDecodeError as e:
            return "open escape" if e.reason == "unexpected end of data" else None
        return "open escape" if m[2] else None
    return None


def closing_line(line: str) -> str:
    """A line as closing lines are counted: numbers and names behind the first word masked."""
    first, _, rest = re.sub(r"\d+", "0", line.strip()).partition(" ")
    return f"{first} {re.sub(r'[^\W\d_a-z][^\W\d_]*', 'X', rest)}".strip()


def judge(text: str) -> tuple[str | None, str | None, str | None]:
    """(reason, closing line, last word). A reason alone: certainly cut. A line: cut unless the corpus closes so.
    A line and a word: cut if the corpus neither closes so nor knows the word as the end of a line. All null: whole."""
    body = text.rstrip()
    if not body:
        return None, None, None
    broken = open_sequence(body)
    if broken:
        return broken, None, None
    lines = [x for x in body.split("\n") if x.strip()]
    last = lines[-1].strip()
    if _MARK.search(body):
        return "cut mark", closing_line(last) if last.endswith((" …", "...")) else None, None
    stack = open_elements(body)
    if stack and stack[0] in ("```", "~~~"):
        return "open fence", None, None
    if last.startswith("|"):
        before = lines[-2].strip() if len(lines) > 1 else ""
        short = before.startswith("|") and before.endswith("|") and last.count("|") < before.count("|")
        return ("open table row", None, None) if len(last) < 2 or not last.endswith("|") or short else (None, None, None)
    if stack:
        return _OPEN.get(stack[-1][0], "open bracket"), None, None
    if re.search(r"<[A-Za-z/!][^<>]*$", last):
        return "open markup", None, None
    if re.match(r"^(```|~~~|-{3,}|\*{3,}|={3,})", last):
        return None, None, None
    run = _RUN.findall(last)
    word = run[-1] if run and last.endswith(run[-1]) else None
    if _HEAD.match(last) or _ITEM.match(last) or _POINTER.match(last):
        line = re.sub(r"\d+", "0", last) if _HEAD.match(last) else None
        return ("cut word", line, word) if word else (None, None, None)
    if re.fullmatch(r"#+|[-*+•]", last):
        return "open item", None, None
    if last.endswith("..."):
        return "no terminator", closing_line(last), None
    if _TERMINATED.search(last):
        return None, None, None
    return "no terminator", closing_line(last), None


def _features(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for d, s, t in zip(x["doc_id"], x["source"], x["text"]):
                rows.append((d, s, len(t), len(t.encode("utf-8", "surrogatepass")), *judge(t)))
            yield pd.DataFrame(rows, columns=["doc_id", "source", "n_chars", "n_bytes", "reason", "line", "word"])

    return docs.select("doc_id", F.col("source").cast("string"), "text").where("text IS NOT NULL").mapInPandas(run, FEATURES.format(kind=kind))


def _word_places(docs: DataFrame) -> DataFrame:
    """word -> how often it stands inside a line, and at the end of one (the last line of each text is left out)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside, ends = Counter(), Counter()
        for x in batches:
            for t in x["text"]:
                for line in t.rstrip().split("\n")[:-1]:
                    w = _RUN.findall(line)
                    if w:
                        if line.rstrip().endswith(w[-1]):
                            ends[w[-1]] += 1
                            del w[-1]
                        inside.update(w)
            if len(inside) > 200_000:
                yield pd.DataFrame([(w, inside[w], ends[w]) for w in inside.keys() | ends.keys()], columns=["word", "inside", "ends"])
                inside, ends = Counter(), Counter()
        yield pd.DataFrame([(w, inside[w], ends[w]) for w in inside.keys() | ends.keys()], columns=["word", "inside", "ends"])

    counted = docs.select("text").where("text IS NOT NULL").mapInPandas(run, "word string, inside long, ends long")
    return counted.groupBy("word").agg(F.sum("inside").alias("inside"), F.sum("ends").alias("ends"))


def paragraph_ends(text: str) -> Iterator[str]:
    """The last lines of the paragraphs of prose, without the text's last paragraph."""
    fenced = False
    for p in _BREAK.split(text.rstrip())[:-1]:
        marks = len(_FENCE.findall(p))
        within, fenced = fenced, fenced ^ (marks % 2 == 1)
        last = p.rstrip().split("\n")[-1].strip()
        if last and not (within or marks or last[0] == "|" or _HEAD.match(last) or _ITEM.match(last) or _POINTER.match(last) or re.match(r"^(-{3,}|\*{3,}|={3,})", last)):
            yield last


def _habits(docs: DataFrame, closers: set[str]) -> DataFrame:
    """source -> ends, bare: its paragraphs' ends and those without a terminator; pages, titles: its pages and those that have no
    terminator at the end nor between sentences. Recurring closing lines count for neither ends nor titles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            n: dict[str | None, list[int]] = {}
            for s, t in zip(x["source"], x["text"]):
                c = n.setdefault(s, [0, 0, 0, 0])
                for last in paragraph_ends(t):
                    bare = not _TERMINATED.search(last)
                    if not bare or closing_line(last) not in closers:
                        c[0] += 1
                        c[1] += bare
                c[2] += 1
                if not _SENTENCE.search(t.rstrip()):  # the automaton need not read the others again
                    reason, line, _ = judge(t)
                    c[3] += reason == "no terminator" and line not in closers
            yield pd.DataFrame([(s, *c) for s, c in n.items()], columns=["source", "ends", "bare", "pages", "titles"])

    counted = docs.select(F.col("source").cast("string"), "text").where("text IS NOT NULL").mapInPandas(run, "source string, ends long, bare long, pages long, titles long")
    return counted.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("ends", "bare", "pages", "titles")])


def source_baselines(feat: DataFrame, habits: DataFrame, least: int = 5, pile: float = 0.005, habit: float = 0.5, few: int = 20) -> DataFrame:
    """source -> its limits in characters and bytes (null: none), and whether missing terminators are its habit: told from `few`
    paragraph ends on, and for sources without these from `few` pages on."""
    usual_bare = F.when(F.col("ends") >= few, F.col("bare") > habit * F.col("ends")).otherwise((F.col("pages") >= few) & (F.col("titles") > habit * F.col("pages")))
    told = habits.select(F.col("source").alias("h"), usual_bare.alias("habit"))
    one = feat.withColumnRenamed("source", "src")
    top = one.groupBy("src").agg(
        F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("mc"), F.max("n_bytes").alias("mb")
    )
    top = top.join(told, F.col("src").eqNullSafe(F.col("h"))).drop("h")
    sizes = one.groupBy(F.col("src").alias("s"), "n_chars", "n_bytes").agg(F.count(F.lit(1)).alias("c"))
    at = (
        sizes.join(top, F.col("s").eqNullSafe(F.col("src")))
        .groupBy("src", "n", "mc", "mb", "habit")
        .agg(
            F.sum(F.when(F.col("n_chars") == F.col("mc"), F.col("c")).otherwise(0)).alias("at_mc"),
            F.sum(F.when(F.col("n_bytes") > F.col("mb") - 4, F.col("c")).otherwise(0)).alias("at_mb"),
            F.sum(F.when(F.col("n_chars").between(0.9 * F.col("mc"), F.col("mc") - 1), F.col("c")).otherwise(0)).alias("by_mc"),
            F.sum(F.when(F.col("n_bytes").between(0.9 * F.col("mb"), F.col("mb") - 4), F.col("c")).otherwise(0)).alias("by_mb"),
        )
    )
    usual = lambda c, width: F.col(f"by_{c}") * width / (F.col(c) * 0.1 + 1)  # noqa: E731  what that many lengths just below hold
    piled = lambda c, width: F.col(f"at_{c}") >= F.greatest(F.lit(least), F.col("n") * pile, 10 * usual(c, width))
    return at.select(
        "src", F.when(piled("mc", 1), F.col("mc")).alias("limit_chars"), F.when(piled("mb", 4), F.col("mb")).alias("limit_bytes"), "habit"
    )


def judged(docs: DataFrame, share: float = 0.0005, salts: int = 16, seldom: float = 0.25) -> DataFrame:
    """One row per doc_id: source, cut (boolean), reason. A word does not end lines if its share of line ends, taken with three
    more ends than were seen, is below `seldom` of the share among all words; a rare word's is not."""
    feat = materialise(_features(docs), "truncation")
    n = feat.count()
    lines = feat.where("line IS NOT NULL").groupBy("line").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= F.lit(max(3.0, share * n)))
    closers = F.broadcast(lines.select("line", F.lit(True).alias("closes")))  # at most 1 / share rows
    asked = feat.where("word IS NOT NULL").select("word").distinct()
    places = materialise(_word_places(docs), "words")
    of_all = places.agg(F.coalesce(F.sum("ends") / F.sum(F.col("inside") + F.col("ends")), F.lit(0.0))).first()[0]
    known = asked.join(places, "word", "left").na.fill(0, ["inside", "ends"])
    seen = F.col("inside") + F.col("ends")
    odd = known.where((seen == 0) | (F.col("ends") + 3 < seen * F.lit(seldom * of_all))).select("word", F.lit(True).alias("odd"))
    habits = _habits(docs, {r["line"] for r in closers.select("line").collect()})
    base = source_baselines(feat, habits).withColumn("base_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    f = feat.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    f = f.join(closers, "line", "left").join(odd, "word", "left")
    f = f.join(base, F.col("source").eqNullSafe(F.col("src")) & (F.col("salt") == F.col("base_salt")), "left")
    limit = (F.col("n_chars") == F.col("limit_chars")) | (F.col("n_bytes") > F.col("limit_bytes") - 4)
    unsure = (
        F.when(F.col("word").isNotNull(), F.coalesce("odd", F.lit(False)) & ~F.coalesce("closes", F.lit(False)))
        .when((F.col("reason") == "no terminator"), ~F.coalesce("closes", F.lit(False)) & ~F.col("habit"))
        .when(F.col("line").isNotNull(), ~F.coalesce("closes", F.lit(False)))
        .otherwise(F.col("reason").isNotNull())
    )
    reason = F.when(unsure, F.col("reason")).when(limit, F.lit("field limit"))
    return f.select("doc_id", "source", reason.isNotNull().alias("cut"), reason.alias("reason")).dropDuplicates(["doc_id"])


def truncation_shares(rows: DataFrame) -> DataFrame:
    """Per source: pages, cut pages and their share."""
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.col("cut").cast("int")).alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("share"))
