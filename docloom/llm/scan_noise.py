"""Problem 3: text of scanned pages, its kinds of noise and its repair.

Method: averaged perceptrons trained here. A line model tells body lines from running heads and page numbers by page-position features
(breaks in the sentence around a line, how alike lines come back, what stands next to them, whether numbers count up). A character editor
predicts for each place of a word that may have been misread, and each word divided at a line end, one of keep, replace, delete, insert and
join: what is read and what would be meant leave one action beside keep ("act"), which is among its features, and context is learnt for all
alike. Its features are the signs read and meant, their neighbours, and how many texts have the word as it stands and as it would become. A word is edited if the editor would rather make each of its edits than keep what stands there. Both are trained on clean texts of
the corpus, into which the printer's lines and the scanner's slips are put on purpose: at most ``SAMPLE`` texts, whole, those with the least hash of
their id.

Whatever depends on the corpus covers all of it: the words of all texts are counted, a scanned text (case and blanks aside) once however
many ids it has, so that its copies don't vouch for its slips, other files each; candidate edits of all word forms of scanned pages
are generated, joined with the counts and scored once per form, not once per occurrence (edits of words of over
``WRITTEN_OUT`` letters by a key that no edit changes; up to ``SLIPS`` slips in a word of any length); the forms found to be misread are joined back to
the documents. The models are a few thousand weights; no word list is collected or broadcast.

Defined cases: null and blank texts and files other than ``pdf`` have no noise; a text of one page without repeated lines can't have a
running head; the last word of a text may be cut off and is not judged; codes (digits beside capitals, hyphens or underscores) and names
without a common look-alike are never misread; documents opened twice count once; empty tables give no rows.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut_lineage

SAMPLE = 400
ROUNDS = 6
SEED = 11
LEAST_COMMON = 4
KINDS = ("hyphen_break", "misread", "running_head", "page_number")

#: Pieces a scanner misreads and what it reads instead.
CONFUSIONS = (("e", "c"), ("t", "f"), ("a", "o"), ("o", "0"), ("i", "l"), ("d", "cl"), ("s", "5"), ("l", "1"), ("u", "ii"), ("m", "rn"), ("g", "q"), ("h", "b"), ("w", "vv"), ("ri", "n"), ("rn", "m"), ("cl", "d"), ("b", "6"), ("g", "9"), ("z", "2"), ("i", "1"), ("nn", "m"), ("n", "ri"), ("li", "h"), ("c", "e"), ("y", "v"))
#: What stands for the word "page", before or after its number.
_PAGE_WORDS = r"(?:pages?|p|pp|pag|pág|página|seite|s|blatt|folio|f|hoja|sheet|no|nr)"
_NUMBER = re.compile(rf"^[\W_]*(?:{_PAGE_WORDS}[.:]?\s*)?[\W_]*(\d{{1,4}}|[ivxlc]{{1,7}})[\W_]*(?:(?:/|of|von|de|sur|\|)\s*\d{{1,4}}|{_PAGE_WORDS}\.?)?[\W_]*$", re.I)
_PIECE = re.compile(r"[^\W_]+(?:[-'’_.][^\W_]+)*")
_HYPHEN = re.compile(r"([^\W\d_]+)[-­‐‑¬][ \t]*$")
_HYPHENS = frozenset("-\u00ad\u2010\u2011\u00ac")
_OPENING = re.compile(r"^\s*([^\W\d_]+)")
_FOLD = ((re.compile("vv"), "w"), (re.compile("cl"), "d"), (re.compile("rn|ri"), "m"), (re.compile("ii"), "u"))
_FOLD_SIGNS = str.maketrans({"c": "e", "f": "t", "0": "a", "o": "a", "l": "i", "1": "i", "j": "i", "5": "s", "q": "g", "9": "g", "b": "h", "6": "h", "n": "m", "2": "z", "v": "y"})


_THREE_LETTERS = re.compile(r"[^\W\d_][\W\d_]*[^\W\d_][\W\d_]*[^\W\d_]")
_BY_FIRST = {(meant[0], read[0]): (meant, read) for meant, read in CONFUSIONS}
_BONES = str.maketrans({"n": "r", "c": "e", "d": "e", "f": "t", "o": "a", "0": "a", "5": "s", "q": "g", "9": "g", "2": "z", "v": "y", **dict.fromkeys("il1uhb6")})
SLIPS = 3
#: Signs of a folded title from which on it may be blurred; shorter ones have to be equal.
LEAST_BLURRED = 8
#: Letters from which on a word's edits are searched among the counted forms instead of written out.
WRITTEN_OUT = 24


class Perceptron:
    """An averaged perceptron over named features; ``labels[0]`` wins ties."""

    def __init__(self, labels: tuple[str, ...]):
        self.labels = labels
        self.weights: dict[str, dict[str, float]] = {}

    def scores(self, features: list[str]) -> dict[str, float]:
        out = dict.fromkeys(self.labels, 0.0)
        for name in features:
            for label, weight in self.weights.get(name, {}).items():
                out[label] += weight
        return out

    def label(self, features: list[str]) -> str:
        scores = self.scores(features)
        return max(self.labels, key=lambda x: scores[x])

    def train(self, rows: list[tuple[list[str], str]], rounds: int = ROUNDS, seed: int = SEED) -> Perceptron:
        sums: dict[str, dict[str, float]] = defaultdict(lambda: dict.fromkeys(self.labels, 0.0))
        step, order = 1, list(range(len(rows)))
        shuffled = random.Random(seed)
        for _ in range(rounds):
            shuffled.shuffle(order)
            for at in order:
                features, gold = rows[at]
                guess = self.label(features)
                if guess != gold:
                    for name in features:
                        own = self.weights.setdefault(name, dict.fromkeys(self.labels, 0.0))
                        own[gold] += 1
                        own[guess] -= 1
                        sums[name][gold] += step
                        sums[name][guess] -= step
                step += 1
        for name, own in self.weights.items():
            for label in self.labels:
                own[label] -= sums[name][label] / step
        return self


# ---------------------------------------------------------------- lines


def fold(line: str) -> str:
    """A line without what a blurred scan may change: case, signs and the pieces a scanner confuses."""
    text = line.lower()
    for pattern, piece in _FOLD:
        text = pattern.sub(piece, text)
    return re.sub(r"[\W\d_]+", " ", text.translate(_FOLD_SIGNS)).strip()


def _number_value(line: str) -> int | None:
    match = _NUMBER.match(line.strip())
    if not match:
        return None
    found = match.group(1).lower()
    if found.isdigit():
        return int(found)
    value, last = 0, 0
    for sign in reversed(found):
        worth = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[sign]
        value += worth if worth >= last else -worth
        last = max(last, worth)
    return value


def _notation(line: str) -> str:
    return re.sub(r"[ivxlc]{1,7}(?![a-z])", "0", re.sub(r"\d+", "0", line.strip().lower())) if not re.search(r"\d", line) else re.sub(r"\d+", "0", line.strip().lower())


def _alike(a: str, b: str, left: set[str], right: set[str]) -> bool:
    """Whether two folded lines are the same title, perhaps blurred or one with another title beside it."""
    short, long = sorted((a, b), key=len)
    if len(long) > len(short) + 3:
        return long.startswith(short[:-2]) or long.endswith(short[2:])
    return len(left & right) >= 0.6 * len(left | right)


def _title_groups(folded: dict[int, str]) -> dict[int, list[int]]:
    """For each title line with others like it, the lines of its group: equal folded titles, and those like the first of the group.

    Titles are compared only where they share one of their rarer grams (any two that are alike do), or where one begins or ends with the
    other; a title that joins a group isn't compared with later ones, so a head blurred in a thousand ways costs one comparison each.
    """
    by_text: dict[str, list[int]] = defaultdict(list)
    for i, key in folded.items():
        by_text[key].append(i)
    grams = {key: {key[j : j + 3] for j in range(len(key) - 2)} for key in by_text if len(key) >= LEAST_BLURRED}
    seen = Counter(g for own in grams.values() for g in own)
    leads: dict[str, list[str]] = defaultdict(list)
    starts: dict[str, str] = {}
    ends: dict[str, str] = {}
    group: dict[str, str] = {key: key for key in by_text}
    for key in sorted(grams, key=lambda k: (len(k), k)):
        own = grams[key]
        shared = [g for g in own if seen[g] > 1]
        rare = sorted(shared, key=lambda g: (seen[g], g))[: len(shared) - -(-6 * len(own) // 10) + 1] if 10 * len(shared) >= 6 * len(own) else []
        found = next((starts[key[:j]] for j in range(len(key) - 6, LEAST_BLURRED - 3, -1) if key[:j] in starts), None)
        found = found or next((ends[key[j:]] for j in range(6, len(key) - LEAST_BLURRED + 3) if key[j:] in ends), None)
        if not found:
            tried = {o for g in rare for o in leads[g]}
            found = next((o for o in sorted(tried) if _alike(o, key, grams[o], own)), None)
        if found:
            group[key] = found
            continue
        for g in rare:
            leads[g].append(key)
        starts.setdefault(key[:-2], key)
        ends.setdefault(key[2:], key)
    members: dict[str, list[int]] = defaultdict(list)
    for key, lines in by_text.items():
        members[group[key]] += lines
    return {i: sorted(lines) for lines in members.values() if len(lines) > 1 for i in lines}


def line_features(lines: list[str]) -> list[tuple[int, list[str], str]]:
    """(line index, features, candidate kind) of the lines that may be page furniture; the work grows with the lines, not their pairs."""
    stripped = [x.strip() for x in lines]
    values = [_number_value(x) if x else None for x in stripped]
    numbers = [i for i, v in enumerate(values) if v is not None]
    numbered = set(numbers)
    titled = {i for i, x in enumerate(stripped) if x and x[-1] not in ".!?;" and i not in numbered and _THREE_LETTERS.search(x)}
    folded = {i: fold(stripped[i]) for i in sorted(titled)}
    twin = _title_groups(folded)
    furniture = numbered | set(twin)
    befores, afters, last = [""] * len(lines), [""] * len(lines), ""
    for i, x in enumerate(stripped):
        befores[i] = last
        last = x if x and i not in furniture else last
    last = ""
    for i in range(len(stripped) - 1, -1, -1):
        afters[i] = last
        last = stripped[i] if stripped[i] and i not in furniture else last

    def broken(i: int) -> bool:
        before, after = befores[i], afters[i]
        return bool(before) and bool(after) and (after[0].islower() or (not re.search(r"[.!?:;…]\W*$", before) and len(before) > 25))

    sizes = sorted(len(x) for x in stripped if x and len(x) > 30)
    wrapped = bool(sizes) and sizes[-1 - len(sizes) // 10] <= 100
    near = lambda i: [j for j in (i - 3, i - 2, i - 1, i + 1, i + 2, i + 3) if 0 <= j < len(stripped)]
    out: list[tuple[int, list[str], str]] = []
    by_shape: dict[str, list[int]] = defaultdict(list)
    for i in numbers:
        by_shape[_notation(stripped[i])].append(i)
    for shape, same in by_shape.items():
        up = sum(values[b] == values[a] + 1 for a, b in zip(same, same[1:], strict=False))
        series = "all" if same[1:] and up == len(same) - 1 else "most" if up * 2 >= len(same) > 1 else "few" if up else "none"
        page = bool(re.search(_PAGE_WORDS + r"\b", shape)) and shape != "0"
        bare = shape == "0"
        for at, i in enumerate(same):
            value = values[i]
            counts = (at > 0 and values[same[at - 1]] in (value - 1, value - 2)) + (at + 1 < len(same) and values[same[at + 1]] in (value + 1, value + 2))
            cut = broken(i)
            features = ["number", f"counts={counts}", f"decorated={not bare}", f"counts={counts},decorated={not bare}", f"series={series}", f"alone={len(same) == 1}", f"alone={len(same) == 1},decorated={not bare}", f"broken={cut}", f"broken={cut},counts={counts}", f"wrapped={wrapped}", f"wrapped={wrapped},counts={counts}", f"page={page}", f"head={any(j in twin for j in near(i))}", f"blank={sum(not stripped[j] for j in (i - 1, i + 1) if 0 <= j < len(stripped))}", f"short={any(j in titled and j not in twin for j in (i - 1, i + 1))}"]
            out.append((i, features, "page_number"))
    about: dict[int, tuple] = {}
    for i in twin:
        group = twin[i]
        if group[0] not in about:
            cut = sum(broken(j) for j in group)
            own = "own" if len({afters[j] for j in group}) > 1 and len({befores[j] for j in group}) > 1 else "copy"
            about[group[0]] = cut, own, sum(any(k in numbered for k in near(j)) for j in group), len({folded[j] for j in group})
        cut, own, beside, forms = about[group[0]]
        paired = bool(re.search(r" \| |\s{2,}", stripped[i]))
        mark = bool(re.match(r"^\s*(?:[-*•+]|\w[.)]|\d+[.)])\s", lines[i]))
        features = ["title", f"times={min(len(group), 4)}", f"cut={'none' if not cut else 'some' if cut * 3 < len(group) else 'many'}", f"cut1={broken(i)}", f"context={own}", f"cut={cut > 0},context={own}", f"numbered={'none' if not beside else 'some' if beside * 2 < len(group) else 'most'}", f"numbered={beside > 0},cut={cut > 0}", f"caps={stripped[i].isupper()}", f"upper={stripped[i][0].isupper() or not stripped[i][0].isalpha()}", f"mark={mark}", f"words={min(len(stripped[i].split()), 12) // 3}", f"letters={min(len(stripped[i]), 16) // 4}", f"next={'lower' if afters[i][:1].islower() else 'upper'}", f"comma={stripped[i].count(',') > 0 and not stripped[i].endswith(',')}", f"mark={mark},cut={cut > 0}", f"wrapped={wrapped}", f"wrapped={wrapped},cut={cut > 0}", f"numbered={beside * 2 >= len(group)},context={own}", f"pair={paired}", f"full={len(stripped[i]) * 10 > 9 * sizes[len(sizes) // 2] if sizes else False}", f"ends={bool(re.search(r'[ ][0-9]+$', stripped[i]))}", f"groups={forms > 1},pair={paired}"]
        out.append((i, features, "running_head"))
    return out


def furniture_of(text: str, model: Perceptron) -> dict[int, str]:
    """The lines that are page furniture, with their kind, as the line model says; a head comes back, so one line alone is none."""
    lines = text.split("\n")
    if len(lines) < 3:
        return {}
    found = {i: kind for i, features, kind in line_features(lines) if model.label(features) == kind}
    if sum(k == "running_head" for k in found.values()) == 1:
        found = {i: k for i, k in found.items() if k != "running_head"}
    return found


# ---------------------------------------------------------------- words


def words_of(text: str, skip: set[int] = frozenset()) -> tuple[set[str], set[tuple[str, str]], set[str]]:
    """(plain words, pairs divided at line ends, hyphenated compounds) of a text, furniture lines left out; case is kept."""
    body = [x for i, x in enumerate(text.split("\n")) if i not in skip and x.strip()]
    divided: set[tuple[str, str]] = set()
    ends = {i: m for i, x in enumerate(body[:-1]) if x.rstrip()[-1:] in _HYPHENS and (m := _HYPHEN.search(x))}
    for i, end in ends.items():
        opening = _OPENING.match(body[i + 1])
        body[i] = body[i][: end.start()]  # the parts of a divided word are no words
        if opening and (opening.group(1)[0].islower() or end.group(1).isupper()):
            divided.add((end.group(1), opening.group(1)))
            body[i + 1] = re.sub(r"^\s*\w+(?:[-'’_.][^\W_]+)*", "", body[i + 1])
            if i + 1 in ends:
                again = _HYPHEN.search(body[i + 1])
                ends[i + 1] = again if again else ends[i + 1]
    if body:
        found = list(_PIECE.finditer(body[-1]))
        body[-1] = body[-1][: found[-1].start()] if found else body[-1]  # the last word may be cut off
    pieces = set(_PIECE.findall("\n".join(body)))
    words = {w for w in pieces if w.isalnum()}
    compounds: set[str] = set()
    for piece in pieces - words:
        if "-" in piece:
            compounds.add(piece)
        elif "." not in piece and "_" not in piece:
            words.update(re.split(r"['’]", piece))
    return {w for w in words if len(w) >= 2}, divided, compounds


@lru_cache(maxsize=100_000)
def _case_ok(word: str) -> bool:
    """Whether a form may be an ordinary misread word: lower case but for its first letter, and mostly letters."""
    letters = sum(c.isalpha() for c in word)
    return len(word) >= 3 and word[1:] == word[1:].lower() and letters >= 2 and letters * 2 > len(word) and not re.search(r"\d\d", word) and not re.fullmatch(r"\d+\w{1,3}|\w\d+", word)


def corrections(word: str, most: int = SLIPS) -> dict[str, tuple[tuple[int, str, str], ...]]:
    """All edited forms of a word with their edits (place, piece read, piece meant), of up to ``most`` edits; their number grows with the
    word's length to the power of ``most``, so longer words are compared with the forms of their ``skeleton`` instead."""
    low = word.lower()
    out: dict[str, tuple] = {}
    frontier: list[tuple[str, int, tuple]] = [(low, 0, ())]
    for _ in range(most):
        grown: list[tuple[str, int, tuple]] = []
        for text, begin, edits in frontier:
            for meant, read in CONFUSIONS:
                at = text.find(read, begin)
                while at >= 0:
                    fixed = text[:at] + meant + text[at + len(read) :]
                    if fixed not in out and fixed != low:
                        out[fixed] = (*edits, (at, read, meant))
                        grown.append((fixed, at + len(meant), out[fixed]))
                    at = text.find(read, at + 1)
        frontier = grown
    return out


def edits_between(word: str, fixed: str, most: int = SLIPS) -> tuple[tuple[int, str, str], ...] | None:
    """The edits that make ``fixed`` of a word, None if it takes more than ``most`` or other ones.

    The pieces of a confusion differ in their first sign, and no two confusions share both first signs: each place where the words part
    is an edit, and only one can stand there.
    """
    low, edits, i, j = word.lower(), [], 0, 0
    while True:
        while i < len(low) and j < len(fixed) and low[i] == fixed[j]:
            i, j = i + 1, j + 1
        if i == len(low) and j == len(fixed):
            return tuple(edits)
        meant, read = _BY_FIRST.get((fixed[j : j + 1], low[i : i + 1]), ("", ""))
        if not meant or len(edits) == most or not fixed.startswith(meant, j) or not low.startswith(read, i):
            return None
        edits.append((j, read, meant))
        i, j = i + len(read), j + len(meant)


def skeleton(word: str) -> str:
    """What no edit changes: both pieces of each confusion have the same skeleton."""
    return word.replace("m", "nn").replace("w", "vv").translate(_BONES)


def action_of(read: str, meant: str) -> str:
    return "replace" if len(read) == len(meant) else "delete" if len(read) > len(meant) else "insert"


def place_features(word: str, edit: tuple[int, str, str], edits: int, seen: int, common: int) -> list[str]:
    """Features of one place of a word the editor looks at; ``seen`` and ``common``: texts with the word and with what it would become."""
    ratio = common / max(1, seen)
    step = "none" if common < 1 else "less" if ratio < 1 else "even" if ratio < 3 else "more" if ratio < 10 else "much" if ratio < 40 else "far"
    at, read, meant = edit
    low = f" {word.lower()} "
    digit, capital, action = any(c.isdigit() for c in read), word[0].isupper(), action_of(read, meant)
    return ["edit", f"action={action}", f"action={action},ratio={step}", f"ratio={step}", f"edits={edits}", f"ratio={step},edits={min(edits, 2)}", f"common={min(common, LEAST_COMMON)}", f"common={min(common, LEAST_COMMON)},seen={min(seen, 2)}", f"capital={capital}", f"digit={digit}", f"size={min(len(word), 8)}", f"size={min(len(word), 8)},edits={edits}", f"capital={capital},ratio={step}", f"op={read}>{meant}", f"op={read}>{meant},left={low[max(0, at) : at + 1]}", f"op={read}>{meant},right={low[at + 1 + len(read) : at + 2 + len(read)]}", f"op={read}>{meant},ratio={step}"]


def join_features(left: str, right: str, joined: int, compound: int, left_seen: int, right_seen: int) -> list[str]:
    """Features of joining a word over a line end; the counts are documents with the joined word, the compound and either part."""
    level = lambda n: min(n, 3) if n < 8 else 8
    return ["join", f"joined={level(joined)}", f"compound={level(compound)}", f"more={'joined' if joined > compound else 'compound' if compound > joined else 'neither'}", f"parts={left_seen > 0}{right_seen > 0}", f"joined={joined > 0},parts={left_seen > 2 and right_seen > 2}", f"capital={left[0].isupper()}", f"lower={right[0].islower()}", f"joined={joined > 0},compound={compound > 0}"]


# ---------------------------------------------------------------- training


def _noisy_page(rng: random.Random, paragraphs: list[str], titles: list[str]) -> tuple[list[str], dict[int, str]]:
    """A printed version of some paragraphs: wrapped lines, page breaks with or without head and number, and look-alikes of both."""
    width = rng.choice([rng.randint(44, 78)] * 3 + [10_000])
    if width > 100:
        out, labels = [], {}
        label, same = rng.choice(titles), rng.random() < 0.5
        for at, paragraph in enumerate(paragraphs):
            if rng.random() < 0.8:
                out.append(label if same else f"{label} {at + 1}" if rng.random() < 0.7 else rng.choice(titles[:3]))
            out += [paragraph, ""]
        if rng.random() < 0.4:
            for _ in range(rng.randint(3, 7)):
                out += [rng.choice(titles), str(rng.randint(5, 950))]
        return out, labels
    lines: list[str] = []
    for paragraph in paragraphs:
        row = ""
        for word in paragraph.split():
            if row and len(row) + 1 + len(word) > width:
                lines.append(row)
                row = word
            else:
                row = f"{row} {word}" if row else word
        lines += [row] if row else []
        if rng.random() < 0.6:
            lines.append("")
    heads = rng.random() < 0.55
    numbers = rng.random() < 0.6
    decoy = rng.random()
    title = rng.choice(titles)
    second = rng.choice(titles)
    style = rng.choice(["{}", "- {} -", "[ {} ]", "~ {} ~", "p. {}", "Page {}", "Seite {}", "{} / 90", "Page {} of 90", "Pág. {}", "page {}"])
    page, per_page = rng.randint(1, 180), rng.randint(7, 16)
    form = rng.choice(["plain", "caps", "pair", "alternate"])
    whole = rng.random() < 0.25
    opened = heads and rng.random() < 0.5
    filled = 0
    out: list[str] = []
    labels: dict[int, str] = {}
    for at, line in enumerate(lines):
        filled += 1
        if (at == 0 and opened) or (at and (heads or numbers) and (filled >= per_page - 2 and not lines[at - 1] if whole else at % per_page == 0)):
            filled = 0
            if numbers and at:
                if rng.random() < 0.3:
                    out.append("")
                labels[len(out)] = "page_number"
                out.append(style.format(page))
            page += 1
            if rng.random() < 0.5:
                out.append("")
            if heads and rng.random() < 0.93:
                head = {"plain": title, "caps": title.upper(), "pair": f"{title}  -  {second}", "alternate": title if page % 2 else f"{second} | {title}"}[form]
                if rng.random() < 0.3 and len(head) > 6:
                    head = _misread(rng, head, 0.9) if rng.random() < 0.5 else head[:-1] + ","
                labels[len(out)] = "running_head"
                out.append(head)
                if rng.random() < 0.25:
                    out.append("")
        elif not line and decoy < 0.2 and not heads:
            out += ["", title]
            continue
        out.append(line)
    if decoy > 0.85 and not numbers:
        for _ in range(rng.randint(3, 7)):
            out += [rng.choice(titles), str(rng.randint(5, 950))]
    if decoy > 0.9:
        mark = rng.choice(["- ", "a) ", "* "])
        out += [mark + rng.choice(titles[:4]) for _ in range(5)]
    if len([k for k in labels.values() if k == "running_head"]) < 2:
        labels = {i: k for i, k in labels.items() if k != "running_head"}
    return out, labels


def _misread(rng: random.Random, text: str, rate: float) -> str:
    if rng.random() > rate:
        return text
    meant, read = rng.choice(CONFUSIONS[:16])
    places = [i for i in range(len(text)) if text.startswith(meant, i)]
    if not places:
        return text
    at = rng.choice(places)
    return text[:at] + read + text[at + len(meant) :]


def train(texts: list[str], counts: Counter[str]) -> dict[str, Perceptron]:
    """The line model, the edit model and the join model, from clean texts and the documents each of their words occurs in."""
    rng = random.Random(SEED)
    line_rows, edit_rows, join_rows = [], [], []
    paragraphs = [p for t in texts for p in re.split(r"\n\s*\n", t) if len(p) > 120 and re.search(r"[.!?]\s*$", p)]
    titles = sorted({x.strip() for t in texts for x in t.split("\n") if 12 <= len(x.strip()) <= 60 and not re.search(r"[.!?:;,]$|^[-*•#>|]|[<>\\{}|]", x.strip())}) or ["Notes on the first part", "Report of the second year"]
    for _ in range(min(500, 4 * len(paragraphs))):
        chosen = [rng.choice(paragraphs) for _ in range(rng.randint(3, 8))]
        lines, labels = _noisy_page(rng, chosen, rng.sample(titles, min(len(titles), 6)))
        for i, features, kind in line_features(lines):
            line_rows.append((features, labels.get(i, "body") if labels.get(i, "body") in ("body", kind) else "body"))
    known = sorted(w for w, n in counts.items() if n >= LEAST_COMMON and w.isalpha() and len(w) >= 3)
    rare = sorted(w for w, n in counts.items() if n <= 2 and w.isalpha() and len(w) >= 4)
    long = defaultdict(list)
    for other in sorted(w for w in counts if len(w) > WRITTEN_OUT - SLIPS):
        long[skeleton(other)].append(other)

    def places(word: str, fixed: str, edits: tuple, seen: int, common: int, meant: bool) -> None:
        for edit in edits:
            edit_rows.append((place_features(word, edit, len(edits), seen, common), "act" if meant else "keep"))

    def variants(word: str, most: int) -> dict[str, tuple[tuple[int, str, str], ...]]:
        if len(word) <= WRITTEN_OUT:
            return corrections(word, most)
        return {other: edits for other in long.get(skeleton(word), ()) if (edits := edits_between(word, other, most))}

    rng.shuffle(known)
    drawn = random.Random(SEED)
    for word in known[:3000]:
        bad = _misread(rng, _misread(rng, word, 1.0), 0.12)
        if bad != word and counts[bad] * 10 <= counts[word]:
            for fixed, edits in variants(bad, SLIPS).items():
                if fixed == word or counts[fixed]:
                    places(bad, fixed, edits, max(1, counts[bad]), counts[fixed], fixed == word)
            if (edits := edits_between(bad, word)) and not counts[bad]:  # a slip that several texts have is still one, and never what its word means
                slips = int(max(1, counts[word] / 3) ** drawn.random())
                places(bad, word, edits, slips, counts[word], True)
                for n in (max(1, counts[word] // 4), max(1, counts[word] // 2), counts[word]):  # a form nearly as common as what it might mean is a word of its own
                    places(bad, word, edits, counts[word], n, False)
                if back := edits_between(word, bad):
                    for n in (1, slips, max(LEAST_COMMON, slips), max(LEAST_COMMON, counts[word])):
                        places(word, bad, back, counts[word], n, False)
    for word in known[:3000] + rare[:3000]:
        for fixed, edits in variants(word, 2).items():
            if counts[fixed]:
                places(word, fixed, edits, counts[word], counts[fixed], False)
    for word in known[:1500] + rare[:1500]:
        if len(word) >= 6:
            at = rng.randint(2, len(word) - 2)
            left, right = word[:at], word[at:]
            join_rows.append((join_features(left, right, counts[word] - (rng.random() < 0.3), 0, counts[left], counts[right]), "act"))
    for _ in range(1200 if known else 0):
        left, right = rng.choice(known), rng.choice(known)
        seen = rng.choice([0, 1, 2, 5])
        apart = seen == 0 or rng.random() < 0.5  # the parts of a compound may be words of their own or not
        join_rows.append((join_features(left, right, 0, seen, counts[left] * apart, counts[right] * apart), "keep"))
    return {"lines": Perceptron(("body", "running_head", "page_number")).train(line_rows), "editor": Perceptron(("keep", "act")).train(edit_rows + join_rows)}


# ---------------------------------------------------------------- plans


def _texts(sources: DataFrame) -> DataFrame:
    kept = sources.where(F.col("doc_id").isNotNull() & F.col("raw_text").rlike(r"\S"))
    scanned = F.coalesce(F.lower("file_type") == "pdf", F.lit(False))
    return kept.select("doc_id", F.col("raw_text").alias("text"), scanned.alias("scanned"))


def fit(sources: DataFrame) -> dict[str, Perceptron]:
    """Models trained on at most ``SAMPLE`` clean texts of the corpus (files other than scans and web pages)."""
    clean = sources.where(F.col("raw_text").rlike(r"\S") & ~F.coalesce(F.lower("file_type") == "pdf", F.lit(False)) & F.col("origin").isNull())
    chosen = clean.select("doc_id", "raw_text").withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(SAMPLE)
    texts = [r["raw_text"] for r in chosen.collect()]
    counts: Counter[str] = Counter()
    for text in texts:
        counts.update({w.lower() for w in words_of(text)[0]})
    return train(texts, counts)


def _forms(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = model.value["lines"]
        for batch in batches:
            docs, kinds, forms = [], [], []
            counted: Counter[tuple[str, str]] = Counter()
            for doc, text, scanned, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                skip = furniture_of(text, lines) if scanned else {}
                words, divided, compounds = words_of(text, set(skip))
                if first:
                    counted.update(("l", w) for w in {w.lower() for w in words})
                    counted.update(("c", c) for c in {c.lower() for c in compounds})
                if scanned:
                    own = [("w", w) for w in words if _case_ok(w)] + [("j", f"{a}\t{b}") for a, b in divided] + [("f", k) for k in set(skip.values())]
                    docs += [doc] * len(own)
                    kinds += [k for k, _ in own]
                    forms += [f for _, f in own]
            numbers = [1] * len(docs) + list(counted.values())
            docs += [None] * len(counted)
            kinds += [k for k, _ in counted]
            forms += [f for _, f in counted]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(kinds, pa.string()), pa.array(forms, pa.string()), pa.array(numbers, pa.int32())], ["doc", "kind", "form", "n"])

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple[str, str, str | None, str | None]] = []
        for kind, form in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low = form.lower()
            if kind == "j":
                left, right = low.split("\t")
                rows += [(kind, form, x, None) for x in {left + right, f"{left}-{right}", left, right, *corrections(left + right, 1)}]
            elif len(low) <= WRITTEN_OUT:
                rows += [(kind, form, x, None) for x in (low, *corrections(low))]
            else:
                rows += [(kind, form, low, None), (kind, form, low, skeleton(low))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["kind", "form", "other", "bones"])


def _near_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long words beside counted forms of their skeleton: those an edit or more away."""
    for batch in batches:
        lows, others = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        yield batch.filter(pa.array([bool(edits_between(low, other)) for low, other in zip(lows, others, strict=True)], pa.bool_())).select(["kind", "form", "other", "docs"])


def _decide(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor = model.value["editor"]
        for batch in batches:
            out: list[tuple[str, str, str]] = []
            for kind, form, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                seen = {x["other"]: x["docs"] for x in found}
                if kind == "w":
                    fixed = best_edit(form, seen, editor)
                    if fixed:
                        out.append((kind, form, fixed))
                    continue
                left, right = form.split("\t")
                low = (left + right).lower()
                known = max([seen.get(low, 0), *(n for other, n in seen.items() if n >= LEAST_COMMON and len(other) >= len(low) - 1 and "-" not in other and other not in (left.lower(), right.lower()))])
                features = join_features(left, right, known, seen.get(f"{left}-{right}".lower(), 0), seen.get(left.lower(), 0), seen.get(right.lower(), 0))
                if editor.label(features) == "act":
                    out.append((kind, form, left + right))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], ["kind", "form", "fixed"])

    return run


def best_edit(form: str, seen: dict[str, int], model: Perceptron) -> str | None:
    """The form whose edits the editor would all rather make than keep what stands there, if any; ``seen``: texts with each form, copies of
    a scan aside. Of several the one with the highest sum."""
    own = max(1, seen.get(form.lower(), 0))
    best, top = None, 0.0
    for fixed, common in seen.items():
        edits = edits_between(form, fixed)
        if not edits:
            continue
        margins = []
        for edit in edits:
            scores = model.scores(place_features(form, edit, len(edits), own, common))
            margins.append(scores["act"] - scores["keep"])
        if min(margins) > 0 and (sum(margins) > top or (best and sum(margins) == top and fixed < best)):
            best, top = fixed, sum(margins)
    if best and form[0].isupper():
        best = best[0].upper() + best[1:]
    return best


def _plan(sources: DataFrame, models: dict[str, Perceptron] | None = None) -> tuple[DataFrame, DataFrame, object]:
    """(forms of all documents, decided edits and joins, broadcast models)."""
    shared = sources.sparkSession.sparkContext.broadcast(models or fit(sources))
    texts = _texts(sources).groupBy("doc_id").agg(F.min(F.struct("text", "scanned")).alias("t")).select(F.col("doc_id").alias("doc"), F.col("t.text").alias("text"), F.col("t.scanned").alias("scanned"))
    keys = texts.select("doc", "scanned", F.md5(F.regexp_replace(F.trim(F.lower("text")), r"\s+", " ")).alias("key"))
    scans = keys.where("scanned").groupBy("key").agg(F.min("doc").alias("first"))
    copies = keys.join(scans, "key").where("doc != first").select("doc", F.lit(True).alias("copy"))
    texts = texts.join(copies, "doc", "left").select("doc", "text", "scanned", F.col("copy").isNull().alias("first"))
    forms = cut_lineage(texts.mapInArrow(_forms(shared), "doc string, kind string, form string, n int"))
    counts = forms.where("kind in ('l', 'c')").groupBy("form").agg(F.sum("n").cast("int").alias("docs"))
    asked = forms.where("kind in ('w', 'j')").select("kind", "form").distinct().mapInArrow(_candidates, "kind string, form string, other string, bones string")
    counts = counts.withColumnRenamed("form", "other")
    known = asked.where("bones is null").join(counts, "other").select("kind", "form", "other", "docs")
    bones = F.udf(skeleton, "string")
    long = counts.where(F.length("other") > WRITTEN_OUT - SLIPS).withColumn("bones", bones("other"))
    pairs = asked.where("bones is not null").withColumnRenamed("other", "low").join(long, "bones").where("abs(length(low) - length(other)) <= %d" % SLIPS)
    known = known.unionByName(pairs.select("kind", "form", "low", "other", "docs").mapInArrow(_near_long, "kind string, form string, other string, docs int"))
    found = known.groupBy("kind", "form").agg(F.collect_list(F.struct("other", "docs")).alias("found")).select("kind", "form", "found")
    pairs = forms.where("kind = 'j'").select("kind", "form").distinct().join(found, ["kind", "form"], "left").select("kind", "form", F.coalesce("found", F.array().cast("array<struct<other:string,docs:int>>")).alias("found"))
    decided = found.where("kind = 'w'").unionByName(pairs).mapInArrow(_decide(shared), "kind string, form string, fixed string")
    return forms, decided, shared


def find_noise(sources: DataFrame) -> DataFrame:
    """(doc_id, noise_kind): one row for each kind that occurs in a scanned document."""
    forms, decided, _ = _plan(sources)
    lines = forms.where("kind = 'f'").select("doc", F.col("form").alias("noise_kind"))
    marks = forms.where("kind in ('w', 'j')").join(decided.select("kind", "form"), ["kind", "form"], "left_semi")
    words = marks.select("doc", F.when(F.col("kind") == "w", "misread").otherwise("hyphen_break").alias("noise_kind"))
    return lines.unionByName(words).distinct().select(F.col("doc").alias("doc_id"), "noise_kind")


def repaired(text: str, skip: set[int], fixes: dict[str, str], joins: set[str]) -> str:
    """Continuous paragraphs of a scanned text: furniture left out, divided words joined, misread words replaced."""
    lines = [x for i, x in enumerate(text.split("\n")) if i not in skip]
    out: list[str] = []
    gap = False
    for line in lines:
        row = line.strip()
        if not row:
            gap = True
            continue
        if out:
            cut = _HYPHEN.search(out[-1])
            opening = _OPENING.match(row)
            if cut and opening and f"{cut.group(1)}\t{opening.group(1)}" in joins:
                out[-1] = out[-1][: cut.end(1)] + row
                gap = False
                continue
            ended = bool(re.search(r"[.!?:…]\W*$", out[-1]))
            continues = row[0].islower() or (not ended and not gap and len(out[-1]) > 40)
            listed = re.match(r"(?:[-*•+]|\w[.)]|\d+[.)])\s", row)
            if (continues and not listed) or (ended and not gap and not listed and len(out[-1].rsplit("\n", 1)[-1]) > 40):
                out[-1] += ("" if cut and not cut.group(0)[-1].isspace() and "-" in cut.group(0) else " ") + row
                gap = False
                continue
        out.append(row)
        gap = False
    body = "\n\n".join(out)
    return _PIECE.sub(lambda m: fixes.get(m.group(), m.group()), body) if fixes else body


def repair(sources: DataFrame) -> DataFrame:
    """(doc_id, clean_text, noise): every scanned text as readable paragraphs, with the kinds of noise taken out of it."""
    forms, decided, shared = _plan(sources)
    marks = forms.where("kind in ('w', 'j')").join(decided, ["kind", "form"]).groupBy("doc").agg(F.collect_list(F.struct("kind", "form", "fixed")).alias("marks"))
    texts = _texts(sources).where("scanned").groupBy("doc_id").agg(F.min("text").alias("text")).select(F.col("doc_id").alias("doc"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = shared.value["lines"]
        for batch in batches:
            clean, kinds = [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                skip = furniture_of(text, lines)
                fixes = {m["form"]: m["fixed"] for m in found or () if m["kind"] == "w"}
                joins = {m["form"] for m in found or () if m["kind"] == "j"}
                clean.append(repaired(text, set(skip), fixes, joins))
                own = set(skip.values()) | ({"misread"} if fixes else set()) | ({"hyphen_break"} if joins else set())
                kinds.append([k for k in KINDS if k in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array(kinds, pa.list_(pa.string()))], ["doc_id", "clean_text", "noise"])

    return texts.join(marks, "doc", "left").select("doc", "text", "marks").mapInArrow(run, "doc_id string, clean_text string, noise array<string>")
