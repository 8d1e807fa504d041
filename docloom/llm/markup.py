"""Problem 5: markup left in texts, and clean text in its place.

Method: minimum-cut labelling. Everything in a text that could be a construct of HTML, Markdown, wiki or LaTeX markup is a node. A
classifier's two costs (of calling it markup, of calling it plain text) become the capacities to the two terminals; constructs that follow
one another closely, or that open and close the same element, are joined by smoothness edges. The maximum flow then separates markup from
plain text: a weak sign (an indented line, a rule of stars, a colon list) goes with the clear ones around it and stays plain alone.

The classifier is a logistic regression over a node's form and surroundings, trained here on ``WRITTEN`` short texts that ``written_text`` writes
with and without markup (look-alikes of plain text among them); its few hundred weights go to all tasks.

Texts without any such sign are passed over by one character scan. Each text is one row's work, so the job is narrow; only the kinds found
are shuffled, to give repeated rows of a record one row.

Clean text is made node by node, and only from nodes the cut calls markup: all other text stays as it is. It keeps headings (``#`` lines), lists
(``- `` lines where markup made them), code (fenced or in ticks), formulas (between dollar signs) and tables (rows with ``|``), and drops tags, comments, templates, emphasis and
link targets.

Defined cases: null and blank texts have no markup and stay as they are; whole texts are read, and constructs may have any length; records
without an id are left out; the kinds of rows of one record are united; the clean text of a record with several texts is that of its
smallest.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")
NEAR = 400
SMOOTH = 1.6
#: Texts the classifier is trained on, and its passes over them.
WRITTEN = 1500
PASSES = 8
SEED = 5

#: Element names of HTML.
_ELEMENTS = "a abbr address article aside audio b base blockquote body br button canvas caption center cite code col colgroup dd del details div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta nav noscript object ol optgroup option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
_TAG = re.compile(r"</?(?:" + "|".join(_ELEMENTS) + r")(?=[\s/>])(?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>]+))?)*\s*/?>|<!--.*?(?:-->|\Z)|<!doctype\b[^>]*>", re.I | re.S)
_CUT_TAG = re.compile(r"</?(?:" + "|".join(_ELEMENTS) + r")(?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"<>]*\"?|'[^'<>]*'?|[^\s\"'<>]*))?)*\s*/?\Z", re.I)
_ENTITY = re.compile(r"&(?:#\d{2,7};|#x[0-9a-f]{2,6};|[A-Za-z][A-Za-z0-9]{1,30};|(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)) + r")(?![\w;=]))", re.I)
#: Method names with two underscores on either side are names of program parts, not emphasis.
_DUNDERS = {n.strip("_") for kind in (object, int, float, str, list, dict, set, type, BaseException, type(len), type(lambda: 0), type(re)) for n in dir(kind) if n.startswith("__")} | {"main", "all", "enter", "exit", "del", "call", "slots", "path", "file", "next", "await", "aiter", "anext", "version", "author", "builtins", "import", "missing", "bytes", "post_init", "name", "annotations"}
_NUMERIC = re.compile(r"\[\[\s*[-+]?[\d.]+\s*[],]")

_RULES: dict[str, list[tuple[str, str, re.Pattern, str]]] = {}


def _rule(signs: str, kind: str, form: str, pattern: str, role: str = "", flags: int = 0) -> None:
    for sign in signs:
        _RULES.setdefault(sign, []).append((kind, form, re.compile(pattern, flags), role))


# Every class between two signs excludes the closing one, so that a match takes time in proportion to its length.
_rule("[", "wiki", "link", r"\[\[(?!\s)[^\[\]\n]+\]\]")
_rule("[", "wiki", "cut link", r"\[\[(?!\s)[^\[\]\n]+\]?\Z")
_rule("[", "markdown", "footnote", r"\[\^[\w-]+\]")
_rule("[", "markdown", "link", r"\[[^\[\]\n]+\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)")
_rule("[", "markdown", "cut link", r"\[[^\[\]\n]+\]\((?:\.{0,2}/|https?:|img/|#)[^()\s]*\Z")
_rule("!", "markdown", "image", r"!\[[^\[\]\n]*\]\([^()\n]*\)?")
_rule("{", "wiki", "template", r"\{\{[A-Za-z#][^{}]*\}\}")
_rule("{", "wiki", "cut template", r"\{\{[A-Za-z#][^{}]*\}?\Z")
_rule("{", "wiki", "table", r"\{\|(?=\s|\Z)[^\n]*", "open:table")
_rule("|", "wiki", "table end", r"\|\}(?=\s|\Z)", "close:table")
_rule("|", "wiki", "table row", r"(?m:^)\|-+[ \t]*(?=\n|\Z)")
_rule("|", "wiki", "table cell", r"(?m:^)\|(?!\|)[^|\n]*(?=\n|\Z)")
_rule("|", "wiki", "table cells", r"(?m:^)\|(?![|-])[^|\n]*\|\|[^\n]*")
_rule("!", "wiki", "table head", r"(?m:^)! ?[^\n]+")
_rule("'", "wiki", "emphasis", r"'''(?=\S)[^'\n]+'''|(?<!')''(?=[^\s'])[^'\n]+''(?!')")
_rule("=", "wiki", "heading", r"(?m:^)(={2,6})[ \t]*[^=\n][^\n]*?[ \t]*\1[ \t]*(?=\n|\Z)")
_rule("#", "wiki", "redirect", r"(?m:^)#(?:REDIRECT|WEITERLEITUNG|REDIRECTION|REDIRECCIÓN)\b[^\n]*", "", re.I)
_rule("*", "wiki", "stars", r"(?m:^)\*{2,6}[ ]?[^\s*][^\n*]*(?=\n|\Z)")
_rule(":", "wiki", "indent", r"(?m:^):{1,6} ?\S[^\n]*")
_rule(";", "wiki", "term", r"(?m:^);+ ?\S[^\n]*")
_rule("#", "markdown", "heading", r"(?m:^)#{1,6}[ \t]+\S[^\n]*")
_rule("=", "markdown", "underline =", r"(?m:^)={4,}[ \t]*(?=\n|\Z)", "underline")
_rule("-", "markdown", "underline -", r"(?m:^)-{4,}[ \t]*(?=\n|\Z)", "underline")
_rule("-", "markdown", "rule -", r"(?m:^)-{3}[ \t]*(?=\n|\Z)")
_rule("*", "markdown", "rule *", r"(?m:^)(?:\*[ \t]*){3,}(?=\n|\Z)")
_rule("_", "markdown", "rule _", r"(?m:^)_{3,}[ \t]*(?=\n|\Z)")
_rule("*", "markdown", "bold", r"\*\*(?=[^\s*])[^*\n]*?[^\s*]\*\*(?!\*)")
_rule("*", "markdown", "italic", r"(?<![\w*])\*(?=[^\s*])[^*\n]*?[^\s*]\*(?![\w*])")
_rule("_", "markdown", "bold _", r"(?<![\w_])__(?=[^\s_])(?:(?!__)[^\n])*[^\s_]__(?![\w_])", "under")
_rule("~", "markdown", "strike", r"~~(?=\S)[^~\n]+~~")
_rule("`", "markdown", "fence", r"(?m:^)[ ]{0,3}```[^\n`]*(?=\n|\Z)", "fence")
_rule("`", "markdown", "code", r"(?<!`)`(?!`)[^`\n]+`(?!`)")
_rule(">", "markdown", "quote", r"(?m:^)> ?(?=[^\s>])[^\n]*")
_rule("|", "markdown", "table rule", r"(?m:^)\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*(?=\n|\Z)")
_rule("|", "markdown", "table row", r"(?m:^)\|[^|\n]+\|[^\n]*\|[ \t]*(?=\n|\Z)")
_rule("\\", "latex", "command", r"\\(?:begin|end)\{[A-Za-z]+\*?\}|\\(?:(?:sub)*section|chapter|paragraph|part|caption|label|ref|eqref|pageref|cite[a-z]*|footnote|emph|text[a-z]{2}|url|href|title|author|date|documentclass|usepackage|includegraphics|mathrm|mathbf|frac|sqrt|underline|input|include)\*?(?:\[[^\]\n]*\])?\{")
_rule("\\", "latex", "sign", r"\\(?:item|maketitle|noindent|newline|hline|centering|par|quad|qquad|ldots|cdots|times|cdot|alpha|beta|gamma|delta|lambda|sigma|sum|int|prod|le|leq|ge|geq|infty|tableofcontents|newpage|it|bf|em|tt|sc|large|small|LaTeX|TeX)(?![A-Za-z])")
_rule("\\", "latex", "math", r"\\[\[\]()](?=[\s\S])", "math")
_rule("\\", "latex", "cut command", r"\\(?:begin|end|(?:sub)*section|cite|ref|emph|footnote|text(?:bf|it|tt)|label|chapter)\*?(?:\{[A-Za-z]*)?\Z")
_rule("\\", "latex", "escape", r"\\[&%$#_{}](?!\w)|\\\\(?=\s)")
_rule("{", "latex", "group", r"\{\\(?:it|bf|em|tt|sc|sl|rm)\b[^{}\n]*\}?")
_rule("~", "latex", "tie", r"~(?=\\[a-z]+)")
_rule("%", "latex", "comment", r"(?m:^)% ?[A-Za-z][^\n]*")
_rule("$", "latex", "formula", r"\$\$[^$]+\$\$|\$(?=[^\s$])(?:[^$\n]*?[^\s$\\])?\$(?!\d)", "dollar")

_SIGNS = re.compile(r"[<&\[{'=\\$*_`>|%~!#]|^[:;]|^-(?=--)|^(?: {4}|\t)(?=\S)", re.M)
_INDENTED = re.compile(r"(?: {4}|\t)\S[^\n]*")
_CODE = re.compile(r"[=();{}\[\]:<>]|\b(?:def|for|if|while|return|select|import|class|print)\b")
_PROSE_WORDS = re.compile(r"[^\W\d_]{4,}")


class Node:
    """One possible construct: where it stands, of which kind and form, and the classifier's costs of either label."""

    __slots__ = ("start", "end", "kind", "form", "role", "features", "as_markup", "as_plain")

    def __init__(self, start: int, end: int, kind: str, form: str, role: str = "", marks: tuple[str, ...] = ()):
        self.start, self.end, self.kind, self.form, self.role = start, end, kind, form, role
        name = f"{kind}:{form}"
        self.features = ("any", name, *(f"{name},{m}" for m in marks))
        self.as_markup = self.as_plain = 0.0

    def weigh(self, weights: dict[str, float]) -> None:
        odds = max(-20.0, min(20.0, sum(weights.get(f, 0.0) for f in self.features)))
        self.as_markup, self.as_plain = math.log1p(math.exp(-odds)), math.log1p(math.exp(odds))


def candidates(text: str) -> list[Node]:
    """All possible constructs of a text, in order; of one kind they don't overlap."""
    nodes: list[Node] = []
    until = dict.fromkeys(KINDS, 0)
    for found in _SIGNS.finditer(text):
        at, sign = found.start(), found.group()[0]
        if sign == "<":
            match = _TAG.match(text, at)
            if match or (match := _CUT_TAG.match(text, at)):
                if at >= until["html"] and match.end() > at + 1:
                    body = match.group()
                    name = re.match(r"</?([A-Za-z0-9]*)", body).group(1).lower()
                    nodes.append(Node(at, match.end(), "html", "tag" if body.endswith(">") else "cut tag", ("close:" if body.startswith("</") else "open:") + name))
                    until["html"] = match.end()
            continue
        if sign == "&":
            match = _ENTITY.match(text, at)
            if match and (match.group().startswith("&#") or match.group()[1:] in html5 or match.group()[1:].lower() in html5):
                nodes.append(Node(at, match.end(), "html", "entity" if match.group().endswith(";") else "open entity"))
            continue
        if sign in " \t":
            match = _INDENTED.match(text, at)
            if match and at >= until["markdown"]:
                after_blank = at == 0 or text.endswith("\n\n", 0, at)
                nodes.append(Node(at, match.end(), "markdown", "indented", "", (f"blank={after_blank}", f"code={bool(_CODE.search(match.group()))}", f"blank={after_blank},code={bool(_CODE.search(match.group()))}")))
                until["markdown"] = match.end()
            continue
        for kind, form, pattern, role in _RULES.get(sign, ()):
            if at < until[kind]:
                continue
            match = pattern.match(text, at)
            if not match:
                continue
            body, marks = match.group(), ()
            if kind == "wiki" and body.startswith("[[") and _NUMERIC.match(body):
                continue
            if role == "under" and body.strip("_") in _DUNDERS:
                until["markdown"] = match.end()
                break
            if role == "underline":
                line = text[text.rfind("\n", 0, max(0, at - 1)) + 1 : max(0, at - 1)] if at else ""
                marks = (f"under={bool(line.strip())}",)
            if role == "dollar" and not body.startswith("$$"):
                inner = body[1:-1]
                if not inner or _PROSE_WORDS.search(re.sub(r"\\[A-Za-z]+", "", inner)) or not re.search(r"[\\_^=<>+*/|-]|^[A-Za-z]$", inner) or re.match(r"\d[\d.,]*\s", inner):
                    continue
            nodes.append(Node(at, match.end(), kind, form, role, marks))
            until[kind] = match.end() if role not in ("open:table",) and not body.startswith(">") else at + 1
            break
    return nodes


# ---------------------------------------------------------------- classifier

#: What markup is written with, "%" standing for some words; of each form of a node at least one.
_MARKUP = {
    "html": ("<p>%</p>", "<b>%</b> %", "<a href=\"https://a.test/b\">%</a>", "<!-- % -->", "%<br>%", "% &amp; %", "%&nbsp;%", "% &#39;% ", "% &copy %", "<ul><li>%</li><li>%</li></ul>", "<h2>%</h2>", "<div class=\"a\">%</div>", "% <span class=\"no"),
    "markdown": ("# %", "## %", "**%** %", "*%* %", "[%](https://a.test/b)", "![%](img/a.png)", "[^1] %", "~~%~~", "`%` %", "```\n%\n```", "> %", "> %\n> %", "| % | % |\n|---|---|\n| % | % |\n| % | % |", "%\n=====", "%\n-----", "***", "* * *", "__%__ %", "% [%](https://a.t", "---", "___", "%\n\n    x = f(%)"),
    "wiki": ("== % ==", "=== % ===", "[[%|%]] %", "[[%]] %", "{{cite|%}} %", "'''%''' %", "''%'' %", "{| class=a\n! %\n! %\n|-\n| %\n| % || %\n|}", "#REDIRECT [[%]]", "** %\n** %", ": %", "; %", "% [[%", "% {{cite|%", "{{Infobox\n|a=%\n}}"),
    "latex": ("\\section{%}", "\\emph{%} %", "\\begin{itemize}\n\\item %\n\\item %\n\\end{itemize}", "$x_{1} = y^2$ %", "$$a + b$$", "\\[ a = b \\]", "%~\\ref{a} %", "{\\it %} %", "% \\% %", "% \\alpha %", "\\begin{equation}\na = b\n\\end{equation}", "% note %", "% \\cite{", "% \\cite{a} \\& %"),
}
#: Plain text that looks like markup.
_ALIKE = ("----", "-----\n%", "%\n\n-----", "---", "___", "____", "    %", "%\n    %", "for % in %:\n    total += %.size", "def f(%):\n    return g(%)", "\n\n    % %", "% \\& %", ": %", "; %", ": % : %", "| % | %", "| %", "** %", "! %", "% *", "> 3 %", "% * 3 * 4", "*) %", "% $5 and $6 %", "a < 3 and b > 2 %", "% R&D %", "% _a_ %", "f(*args) %", "[1] %", "[[1, 2], [3, 4]]", "% <name> %", "=====\n%", "% ~ %", "100 % of %", "* %", "1. %", "- %", "C:\\new\\% ")
#: How often a text is plain.
_PLAIN = 0.5


def written_text(rng: random.Random) -> tuple[str, str, list[tuple[int, int]]]:
    """(text, its kind of markup or "", stretches written as markup) of one text to train on."""
    words = lambda: " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 7)))
    fill = lambda form: re.sub(r"(?<!\\)%(?! note)", lambda m: words(), form)
    kind = "" if rng.random() < _PLAIN else rng.choice(KINDS)
    text, spans = "", []
    for _ in range(rng.randint(3, 9)):
        turn = rng.random()
        if kind and turn < 0.5:
            piece = fill(rng.choice(_MARKUP[kind]))
            if re.search(r"(?:class=\"no|https://a\.t|\[\[[^\]]*|\{\{[^}]*|\\cite\{)\Z", piece):
                return text + piece, kind, [*spans, (len(text), len(text) + len(piece))]  # cut off
            spans.append((len(text), len(text) + len(piece)))
        elif turn < 0.75 and (not kind or turn < 0.6):
            piece = fill(rng.choice(_ALIKE))
        else:
            piece = ". ".join(words() for _ in range(rng.randint(1, 3))) + "."
        text += piece + ("\n\n" if rng.random() < 0.7 else "\n")
    return text, kind, spans


_TRAINED: list[dict[str, float]] = []


def classifier() -> dict[str, float]:
    """The weights of a node's features, trained once a process; a construct of another kind than its text's, or outside its markup, is plain."""
    if _TRAINED:
        return _TRAINED[0]
    rng, rows = random.Random(SEED), []
    for _ in range(WRITTEN):
        text, kind, spans = written_text(rng)
        for node in candidates(text):
            rows.append((node.features, float(node.kind == kind and any(a <= node.start < b for a, b in spans))))
    weights: dict[str, float] = defaultdict(float)
    for turn in range(PASSES):
        rng.shuffle(rows)
        for features, gold in rows:
            miss = gold - 1.0 / (1.0 + math.exp(-max(-20.0, min(20.0, sum(weights[f] for f in features)))))
            for f in features:
                weights[f] += 0.3 / (1 + turn) * miss
    _TRAINED.append(dict(weights))
    return _TRAINED[0]


# ---------------------------------------------------------------- labels


def _max_flow(size: int, arcs: list[tuple[int, int, float, float]]) -> list[bool]:
    """Dinic's maximum flow from node ``size`` to node ``size + 1``; whether each node stays on the source's side of the minimum cut."""
    source, sink = size, size + 1
    heads: list[list[int]] = [[] for _ in range(size + 2)]
    to: list[int] = []
    room: list[float] = []
    for a, b, forth, back in arcs:
        heads[a].append(len(to))
        to.append(b)
        room.append(forth)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)
    while True:
        level = [-1] * (size + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            node = queue.popleft()
            for arc in heads[node]:
                if room[arc] > 1e-9 and level[to[arc]] < 0:
                    level[to[arc]] = level[node] + 1
                    queue.append(to[arc])
        if level[sink] < 0:
            return [level[n] >= 0 for n in range(size)]
        place = [0] * (size + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                flow = min(room[a] for a in path)
                for a in path:
                    room[a] -= flow
                    room[a ^ 1] += flow
                path, node = [], source
                continue
            while place[node] < len(heads[node]):
                arc = heads[node][place[node]]
                if room[arc] > 1e-9 and level[to[arc]] == level[node] + 1:
                    break
                place[node] += 1
            if place[node] < len(heads[node]):
                path.append(heads[node][place[node]])
                node = to[path[-1]]
            elif path:
                node = to[path.pop() ^ 1]
                place[node] += 1
            else:
                break


def labelled(nodes: list[Node]) -> list[bool]:
    """Whether each construct is markup: the minimum cut over the constructs of each kind."""
    for node in nodes:
        node.weigh(classifier())
    out = [n.as_markup < n.as_plain for n in nodes]
    for kind in KINDS:
        own = [i for i, n in enumerate(nodes) if n.kind == kind]
        if not own or all(out[i] for i in own) or not any(out[i] for i in own):
            continue
        arcs = []
        opened: dict[str, list[int]] = {}
        for at, i in enumerate(own):
            node = nodes[i]
            arcs.append((len(own), at, node.as_plain, 0.0))
            arcs.append((at, len(own) + 1, node.as_markup, 0.0))
            if at:
                gap = max(0, node.start - nodes[own[at - 1]].end)
                weight = SMOOTH * math.exp(-gap / NEAR)
                arcs.append((at - 1, at, weight, weight))
            step, _, name = node.role.partition(":")
            if step == "open":
                opened.setdefault(name, []).append(at)
            elif step == "close" and opened.get(name):
                arcs.append((opened[name].pop(), at, SMOOTH, SMOOTH))
        for at, markup in enumerate(_max_flow(len(own), arcs)):
            out[own[at]] = markup
    return out


def kinds_of(text: str | None) -> list[str]:
    """The kinds of markup of which at least one construct is left in a text."""
    if not text or not _SIGNS.search(text):
        return []
    nodes = candidates(text)
    if not nodes:
        return []
    found = {n.kind for n, markup in zip(nodes, labelled(nodes), strict=True) if markup}
    return [k for k in KINDS if k in found]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, kinds = [], []
        for at, text in enumerate(batch.column(2).to_pylist()):
            for kind in kinds_of(text):
                keep.append(at)
                kinds.append(kind)
        rows = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(kinds, pa.string())], ["field_name", "record_id", "markup"])


def find_markup(records: DataFrame) -> DataFrame:
    """(field_name, record_id, markup), distinct; ``records``: field_name, record_id, text, all STRING."""
    rows = records.select("field_name", "record_id", "text").where(F.col("record_id").isNotNull() & F.col("text").isNotNull())
    return rows.mapInArrow(_find, "field_name string, record_id string, markup string").distinct()


def source_and_cited(sources: DataFrame, citations: DataFrame) -> DataFrame:
    raw = sources.select(F.lit("raw_text").alias("field_name"), F.col("doc_id").alias("record_id"), F.col("raw_text").alias("text"))
    return raw.unionByName(citations.select(F.lit("citation_text").alias("field_name"), F.col("chunk_id").alias("record_id"), "text"))


# ---------------------------------------------------------------- clean text

_LATEX_HEADS = {"part": 1, "chapter": 1, "title": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_LATEX_DROPPED = frozenset("ref eqref pageref cite citep citet citeauthor citeyear label input include includegraphics usepackage documentclass footnote".split())
_LATEX_SIGNS = frozenset("maketitle noindent newline hline centering par newpage tableofcontents it bf em tt sc large small".split())
_CODE_BLOCKS = frozenset(("verbatim", "lstlisting"))
_FORMULA_BLOCKS = frozenset(("equation", "align", "displaymath", "math"))
_BREAKING = frozenset("address article aside blockquote body br details div dl dt dd fieldset figcaption figure footer form head header hr html li main nav ol p pre section summary table tbody tfoot thead title tr ul h1 h2 h3 h4 h5 h6".split())
_HIDDEN = frozenset(("script", "style"))


class Edits:
    """Changes of a text: stretches to replace, and stretches to keep as they are, whatever is found inside."""

    def __init__(self, text: str):
        self.text = text
        self.changes: list[tuple[int, int, str]] = []
        self.kept: list[tuple[int, int]] = []

    def put(self, start: int, end: int, new: str = "") -> None:
        self.changes.append((start, end, new))

    def keep(self, start: int, end: int) -> None:
        self.kept.append((start, end))

    def line(self, start: int, end: int) -> None:
        """Drops a stretch that has its line for itself, with the line's end."""
        self.put(start, end + 1 if self.text[end : end + 1] == "\n" else end)

    def applied(self) -> str:
        out, at, kept, k = [], 0, _merged(self.kept), 0
        for start, end, new in sorted(self.changes, key=lambda c: (c[0], -c[1])):
            while k < len(kept) and kept[k][1] <= start:
                k += 1
            if start < at or (k < len(kept) and kept[k][0] < end and kept[k][0] <= start):
                continue
            if not new and self.text[start - 1 : start] in ("", " ", "\n") and self.text[end : end + 1] == " ":
                end += 1  # what is left out leaves one blank
            out += (self.text[at:start], new)
            at = end
        return "".join(out) + self.text[at:]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _closing_brace(text: str, at: int) -> int:
    """The place of the brace that closes the one before ``at``, or the end of the text."""
    depth = 1
    for found in re.compile(r"(?<!\\)[{}]").finditer(text, at):
        depth += 1 if found.group() == "{" else -1
        if not depth:
            return found.start()
    return len(text)


def _edit_html(nodes: list[Node], edits: Edits) -> None:
    text, fenced, hidden, cells = edits.text, -1, -1, 0
    for node in nodes:
        body = text[node.start : node.end]
        if node.form in ("entity", "open entity"):
            edits.put(node.start, node.end, _html.unescape(body).replace("\xa0", " "))
            continue
        step, _, name = node.role.partition(":")
        opens = step == "open"
        if name in _HIDDEN:
            if opens:
                hidden = node.start
            elif hidden >= 0:
                edits.put(hidden, node.end)
                hidden = -1
            new = ""
        elif name == "pre":
            fenced = node.end if opens else -1
            new = "\n```\n"
        elif name == "code":
            new = "" if fenced >= 0 else "`"
        elif re.fullmatch("h[1-6]", name):
            new = "\n" + "#" * int(name[1]) + " " if opens else "\n"
        elif name == "li":
            new = "\n- " if opens else ""
        elif name in ("td", "th"):
            new, cells = (" | " if opens and cells else ""), cells + opens
        else:
            new = "\n" if name in _BREAKING else ""
        if name == "tr":
            cells = 0
        edits.put(node.start, node.end, new)
    if hidden >= 0:
        edits.put(hidden, len(text))


def _edit_wiki(nodes: list[Node], edits: Edits) -> None:
    text = edits.text
    for node in nodes:
        body = text[node.start : node.end]
        if node.form in ("link", "cut link"):
            inner = body.strip("[]")
            target, bar, label = inner.rpartition("|")
            colon = re.match(r"[A-Za-zÀ-ÿ]+:", inner)
            if colon and not bar:
                edits.put(node.start, node.end)
            else:
                edits.put(node.start, node.end - len(label) - (len(body) - len(body.rstrip("]"))))
                edits.put(node.end - (len(body) - len(body.rstrip("]"))), node.end)
        elif node.form == "heading":
            level = len(body) - len(body.lstrip("="))
            lead = re.match(r"=+[ \t]*", body).end()
            trail = re.search(r"[ \t]*=+[ \t]*$", body).start()
            edits.put(node.start, node.start + lead, "#" * level + " ")
            edits.put(node.start + trail, node.end)
        elif node.form == "emphasis":
            marks = 3 if body.startswith("'''") else 2
            edits.put(node.start, node.start + marks)
            edits.put(node.end - marks, node.end)
        elif node.form in ("template", "cut template"):
            edits.put(node.start, node.end)
        elif node.form in ("table", "table end", "table row"):
            edits.line(node.start, node.end)
        elif node.form in ("table cell", "table cells", "table head"):
            edits.put(node.start, node.end, re.sub(r"\s*(?:\|\||!!)\s*", " | ", re.sub(r"^[|!][ \t]?", "", body)))
        elif node.form == "redirect":
            target = re.search(r"\[\[([^\]|\n]*)", body)
            edits.put(node.start, node.end, target.group(1) if target else body.partition(" ")[2])
        else:  # stars, indent, term: lists
            edits.put(node.start, node.start + re.match(r"[*:;]+[ ]?", body).end(), "- ")


def _edit_markdown(nodes: list[Node], edits: Edits) -> None:
    text, fence = edits.text, -1
    for node in nodes:
        body = text[node.start : node.end]
        if node.form == "fence":
            if fence < 0:
                fence = node.start
            else:
                edits.keep(fence, node.end)
                fence = -1
            continue
        if fence >= 0:
            continue
        if node.form in ("link", "image", "cut link"):
            lead = 2 if node.form == "image" else 1
            edits.put(node.start, node.start + lead)
            edits.put(node.start + body.index("](", lead), node.end)
        elif node.form == "footnote":
            edits.put(node.start, node.end + (text[node.end : node.end + 1] == ":"))
        elif node.form in ("bold", "bold _", "strike", "italic"):
            marks = 1 if node.form == "italic" else 2
            edits.put(node.start, node.start + marks)
            edits.put(node.end - marks, node.end)
        elif node.form in ("underline =", "underline -"):
            before = text.rfind("\n", 0, max(0, node.start - 1)) + 1
            if node.start and text[before : node.start].strip():
                edits.put(before, before, "# " if node.form == "underline =" else "## ")
                edits.put(node.start - 1, node.end)
            else:
                edits.line(node.start, node.end)
        elif node.form in ("rule -", "rule *", "rule _", "table rule"):
            edits.line(node.start, node.end)
        elif node.form == "quote":
            edits.put(node.start, node.start + (2 if body.startswith("> ") else 1))
        elif node.form in ("code", "indented"):
            edits.keep(node.start, node.end)
    if fence >= 0:
        edits.keep(fence, len(text))


def _edit_latex(nodes: list[Node], edits: Edits) -> None:
    text, block = edits.text, -1
    for node in nodes:
        body = text[node.start : node.end]
        if node.form == "formula":
            edits.keep(node.start, node.end)
        elif node.form == "math":
            opens = body[1] in "[("
            start, end = (node.start, re.compile(r"\s*").match(text, node.end).end()) if opens else (node.start - (text[node.start - 1 : node.start] == " "), node.end)
            edits.put(start, end, "$")
            if opens and text.endswith("\\" + "])"[body[1] == "("]):  # the last sign of a text is no node
                edits.put(len(text) - 2, len(text), "$")
        elif node.form in ("comment", "cut command"):
            edits.line(node.start, node.end)
        elif node.form == "escape":
            edits.put(node.start, node.end, "" if body.startswith("\\\\") else body[1:])
        elif node.form == "group":
            edits.put(node.start, node.start + re.match(r"\{\\[a-z]+ ?", body).end())
            if body.endswith("}"):
                edits.put(node.end - 1, node.end)
        elif node.form == "tie":
            following = re.compile(r"\\([a-z]+)").match(text, node.end)
            edits.put(node.start, node.end, "" if following and following.group(1) in _LATEX_DROPPED else " ")
        elif node.form == "sign":
            name = body[1:]
            if name == "item":
                end = re.compile(r"(?:\[[^\]\n]*\])?[ \t]*").match(text, node.end).end()
                edits.put(node.start, end, "- ")
            elif name in _LATEX_SIGNS:
                edits.put(node.start, node.end + (text[node.end : node.end + 1] == " "))
        elif body.startswith(("\\begin{", "\\end{")):
            name = body[body.index("{") + 1 : -1].rstrip("*")
            opens = body.startswith("\\begin")
            if name in _CODE_BLOCKS:
                edits.put(node.start, node.end, "```")
                if opens:
                    block = node.end
                elif block >= 0:
                    edits.keep(block, node.start)
                    block = -1
            elif name in _FORMULA_BLOCKS:
                edits.put(node.start, node.end, "$")
            else:
                edits.line(node.start, re.compile(r"(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?").match(text, node.end).end())
        else:
            name = re.match(r"\\([a-z]+)", body).group(1)
            close = _closing_brace(text, node.end)
            if name in _LATEX_DROPPED:
                edits.put(node.start, close + 1)
            elif name in ("frac", "sqrt", "mathrm", "mathbf"):
                continue
            else:
                edits.put(node.start, node.end, "#" * _LATEX_HEADS[name] + " " if name in _LATEX_HEADS else "")
                edits.put(close, close + 1)


def cleaned(text: str | None) -> tuple[str | None, list[str]]:
    """(the text without the markup found in it, the kinds found). Only constructs the cut calls markup are changed."""
    if not text or not _SIGNS.search(text):
        return text, []
    nodes = candidates(text)
    found = [n for n, markup in zip(nodes, labelled(nodes), strict=True) if markup]
    if not found:
        return text, []
    edits = Edits(text)
    for kind, edit in (("html", _edit_html), ("markdown", _edit_markdown), ("wiki", _edit_wiki), ("latex", _edit_latex)):
        edit([n for n in found if n.kind == kind], edits)
    new = edits.applied()
    new = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n|\Z)", "", new)).strip("\n")
    return new, [k for k in KINDS if any(n.kind == k for n in found)]


def clean(text: str | None) -> str | None:
    return cleaned(text)[0]


def _clean_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [cleaned(t) for t in batch.column(2).to_pylist()]
        columns = pa.array([t for t, _ in done], pa.string()), pa.array([k for _, k in done], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["field_name", "record_id", "clean_text", "markup"])


def clean_records(records: DataFrame) -> DataFrame:
    """(field_name, record_id, clean_text, markup): one row per record with its clean text and the markup found in it."""
    rows = records.where("record_id is not null").groupBy("field_name", "record_id").agg(F.min("text").alias("text"))
    return rows.select("field_name", "record_id", "text").mapInArrow(_clean_rows, "field_name string, record_id string, clean_text string, markup array<string>")
