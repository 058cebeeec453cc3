"""Repairing text that comes from scanned or laid-out pages (problem 3).

Method: lines of the page (running heads, page numbers) are recognised and dropped; what is left is one stream of characters, in which blanks,
line ends and hyphens at line ends are only signs that can be kept or dropped at a cost. A lattice over the positions of the stream holds an arc for
every vocabulary word that can be read there: along a trie, with characters misread for each other, over dropped signs, and after blanks that were lost;
unknown words are arcs too. The cheapest path (Viterbi) is the text. Costs are negative logarithms of the words' shares of all words, so
readings don't depend on the size of the corpus. Where two neighbouring tokens are words of the vocabulary and no arc over the sign
between them can be cheaper, the lattice is cut there, so that only doubtful stretches are decoded. Another dynamic program chooses the paragraphs.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize

#: Least share of all words that a word of the vocabulary has; shares sum to 1, so at most 1 / LEAST_SHARE words are ever sent.
LEAST_SHARE = 5e-7

# Costs, in nats. A sign is what stands between two tokens of the stream.
BLANK, BREAK, MARKED = " ", "\n", "\x02"  # a blank, a line end, a line end after a hyphen
DROP = {BLANK: 14.0, BREAK: 9.0, MARKED: 0.0}
LOST_BLANK, KEPT_HYPHEN, EDIT, MORE_EDITS, ACCENT, INNER_CAPITAL = 5.0, 2.0, 5.0, 2.5, 1.0, 16.0
UNKNOWN, UNKNOWN_LETTER = 13.0, 1.2
#: Most places of a word that are misread.
MOST_EDITS = 2
#: A word whose cost is below this is so common that no misread word can be meant.
SURE = 8.0
#: Words up to this cost are common enough to make two of a pair that could be one.
COMMON = 10.0

# Characters that are misread for each other, in both directions; characters as they stand with what may have been meant; ligatures.
SAME_SHAPE = [("rn", "m"), ("ri", "n"), ("cl", "d"), ("li", "h"), ("vv", "w"), ("ii", "n"), ("ii", "u"), ("l", "i"), ("e", "c"), ("b", "h"), ("f", "t"), ("u", "n"), ("q", "g")]
MEANT = {"m": ["ni", "in", "nn"], "y": ["v"], "v": ["y"], "a": ["o"], "o": ["a", "c", "e"], "k": ["lc"], "t": ["l"], "l": ["t"], "c": ["o"], "s": ["a"], "|": ["l", "i"], "!": ["l", "i"], "1": ["l", "i"], "0": ["o"], "5": ["s"], "6": ["b"], "9": ["g"], "8": ["b"]}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
HYPHENS = "-­‐‑¬"
NO_SIGNS = dict.fromkeys(map(ord, " \n\x02­"))
LAST = "\U0010ffff"  # after all characters of words
STOPS = " \n\x02" + HYPHENS  # what can end a word that isn't split

TOKEN = re.compile(r"[^\W_]+(?:[^\s,.;:?\"()\[\]{}<>@/=+*—–]*[^\W_|])?[|!]?(?:[^\W_]+)?|[|!][^\W_]+")
WORDS = re.compile(r"[^\W\d_]+(?:['’‑-][^\W\d_]+)*")
BROKEN_END = re.compile(rf"[{HYPHENS}](?<=\S[{HYPHENS}])[ \t]*\n\s*\S*")  # a hyphen at a line end, with the token after it
_LETTERS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TAIL = re.compile(r"[^\W_](?:[^\s,.;:?\"()\[\]{}<>@/=+*—–]*)$")
_WORD_TAIL, _WORD_HEAD = re.compile(r"[^\W\d_]+$"), re.compile(r"[^\W\d_]+")
PAGE = re.compile(
    r"(?:[-–—]\s*)?(?:\d{1,4}|[ivxlc]{1,8})(?:\s*[-–—])?|\[\d{1,4}\]|(?:[Pp]|[Pp]g|[Pp]age|[Ss]eite|[Pp]ágina)\.?\s*\d{1,4}(?:\s*(?:of|/|von|de|sur)\s*\d{1,4})?|\d{1,4}\s*(?:/|of)\s*\d{1,4}"
)
ROMAN = re.compile(r"m{0,3}(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})$")
EDGE_NUMBER = re.compile(r"^(\d{1,4}|[ivxlc]{1,8})\s{2,}(\S.*)$|^(.*\S)\s{2,}(\d{1,4}|[ivxlc]{1,8})$")
NOTICE = re.compile(r"(?i)^(?:preprint|under review|draft|manuscript|accepted|published|confidential|copyright|©|arxiv preprint|work in progress|do not distribute)\b.{0,60}$")


def plain(text: str) -> str:
    """Letters without accents and ligatures."""
    for a, b in LIGATURES.items():
        text = text.replace(a, b)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _confusions() -> dict[str, list[tuple[str, float]]]:
    out: dict[str, dict[str, float]] = {}
    for a, b in SAME_SHAPE:
        out.setdefault(a, {})[b] = out.setdefault(b, {})[a] = EDIT
    for a, found in MEANT.items():
        for b in found:
            out.setdefault(a, {}).setdefault(b, EDIT + 1)
    return {a: list(found.items()) for a, found in out.items()}


CONFUSIONS = _confusions()


def whole_tokens(text: str) -> list[str]:
    """What stands between blanks; tokens broken at line ends are left out, with the tokens they go on in."""
    parts, at = [], 0
    for m in BROKEN_END.finditer(text):
        before = text[at : m.start()].rsplit(None, 1)
        if len(before) == 2:
            parts.append(before[0])
        at = m.end()
    return " ".join([*parts, text[at:]]).split()


def words_of(tokens: Counter) -> Counter:
    """The words of counted tokens; a word never goes over a blank, so each different token is looked at once."""
    found: Counter = Counter()
    for t, n in tokens.items():
        for w in (t,) if t.isalpha() else WORDS.findall(t):
            found[w] += n
    return found


def count_words(texts: Iterator[str]) -> Counter:
    """Whole words of texts; words broken at line ends are left out."""
    found: Counter = Counter()
    for t in texts:
        found.update(whole_tokens(t))
    return words_of(found)


#: A step of a prefix along the trie: characters read, longer prefix, first word below it, cost of the step, cost of the cheapest word below it. Moves are the
#: steps over a first misread character, over a further one, and over the character as it stands (one or none).
Step = tuple[int, str, int, float, float]
Moves = tuple[list[Step], list[Step], list[Step]]
#: Costs that differ by less are taken as equal where a way is left because it can't be cheaper.
SLACK = 1e-9


class Decoder:
    """The cheapest reading of a stretch of the stream as words, under the shares of a vocabulary (word -> count)."""

    def __init__(self, vocabulary: dict[str, int], total: int | None = None):
        self.lower: dict[str, int] = {}
        for w, n in vocabulary.items():
            self.lower[w.lower()] = self.lower.get(w.lower(), 0) + n
        self.log_total = math.log(max(total or sum(vocabulary.values()), 1))
        self.words = sorted(self.lower)  # the trie: the words below a prefix are a range
        self.counts = [self.lower[w] for w in self.words]
        self.least = self.log_total - math.log(max(self.lower.values(), default=1))
        self.forms: dict[str, list[tuple[int, str]]] = {}
        for w, n in vocabulary.items():
            self.forms.setdefault(w.lower(), []).append((n, w))
        self.memo: dict[str, tuple[float, list[tuple[int, int, str, bool]], bool]] = {}
        self.moves: dict[str, dict[str, Moves]] = {}  # by the next two characters and the prefix that was read
        self.held = 0

    def known(self, w: str) -> bool:
        return w.lower() in self.lower

    def cost(self, w: str) -> float:
        """Surprise of a word; unknown ones pay by length."""
        n = self.lower.get(w.lower(), 0)
        u = UNKNOWN + UNKNOWN_LETTER * len(w)
        return min(self.log_total - math.log(n), u) if n else u

    def read(self, stream: str) -> list[tuple[int, int, str, bool]]:
        """The arcs (from, to, reading, misread) of the cheapest path over a stream. Signs that the path keeps are arcs of their own: a blank, a line end,
        or `-` for a hyphen that belongs to a compound; a lost blank is an arc of no length."""
        got = self.memo.get(stream)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            got = self._viterbi(stream, False)
            if got[2]:  # an unknown word is in it: blanks may be lost
                got = self._viterbi(stream, True)
            self.memo[stream] = got
        return got[1]

    def _viterbi(self, stream: str, split: bool) -> tuple[float, list[tuple[int, int, str, bool]], bool]:
        end = len(stream)
        low = stream.lower()
        if len(low) != end:  # letters that change their number in small letters
            low = stream
        if self.held > 100_000:
            self.moves, self.held = {}, 0
        best = [math.inf] * (end + 1)
        back: list[tuple[int, str, bool, bool] | None] = [None] * (end + 1)  # from, reading, misread, after a lost blank
        best[0] = 0.0
        most, rest = self._bounds(low)
        for at in range(end):
            here = best[at]
            if here == math.inf:
                continue
            c = stream[at]
            if c == BLANK or c == BREAK:
                if here < best[at + 1]:
                    best[at + 1], back[at + 1] = here, (at, c, False, False)
                continue
            if (c == MARKED or c in HYPHENS) and at:
                if here + KEPT_HYPHEN < best[at + 1]:
                    best[at + 1], back[at + 1] = here + KEPT_HYPHEN, (at, "-", False, False)
                continue
            inside = at > 0 and stream[at - 1] not in " \n\x02" and stream[at - 1] not in HYPHENS
            enter = here + (LOST_BLANK if inside else 0.0)
            if not inside:
                for to, cost in self._unknown(stream, at):
                    if here + cost < best[to]:
                        best[to], back[to] = here + cost, (at, "", False, False)
            elif enter + self.least >= best[end]:
                continue
            for to, word, cost, misread in self._arcs(low, at, best, enter, split, most, rest):
                if inside and len(word) < 2:
                    continue
                if enter + cost < best[to]:
                    best[to], back[to] = enter + cost, (at, word, misread, inside)
        path, at, unknown = [], end, False
        while at > 0:
            came, word, misread, lost = back[at]
            unknown |= not word and stream[came:at].islower()
            if not word or not misread and word not in (" ", "\n", "-"):  # as it stands, without the signs inside
                word = stream[came:at].translate(NO_SIGNS) if not (word and "-" in word and MARKED in stream[came:at]) else stream[came:at].replace(MARKED, "-")
            elif misread:
                word = self.cased(word, stream[came:at])
            path.append((came, at, word, misread))
            if lost:
                path.append((came, came, " ", False))
            at = came
        return best[end], path[::-1], unknown

    def _unknown(self, stream: str, at: int) -> Iterator[tuple[int, float]]:
        """Ends and costs of the unknown words that begin at a position: to the end of the token, and on over marked line ends."""
        to, letters, extra = at, 0, 0.0
        while to < len(stream):
            c = stream[to]
            if c in " \n":
                break
            if c == MARKED or c == "-":
                yield to, UNKNOWN + UNKNOWN_LETTER * letters + extra
                if c == MARKED and stream[to + 1 : to + 2].isupper() and not stream[at:to].isupper():
                    extra += INNER_CAPITAL
                if c == "-":
                    return
            else:
                letters += 1
            to += 1
        yield to, UNKNOWN + UNKNOWN_LETTER * letters + extra

    def _bounds(self, low: str) -> tuple[float, list[float]]:
        """What a path costs that reads each token as it stands (infinite if that is open), and from each position on the least that the signs and tokens after it
        cost: a blank or line end is dropped, or a word begins after it."""
        most = 0.0
        for own in low.replace(BREAK, BLANK).split(BLANK):
            w = own.replace(MARKED, "")
            if not w.isalpha() or own[0] == MARKED or own[-1] == MARKED:
                most = math.inf
                break
            n = self.lower.get(w)
            unknown = UNKNOWN + UNKNOWN_LETTER * len(w) + INNER_CAPITAL * (len(own) - len(w))
            most += min(self.log_total - math.log(n), unknown) if n else unknown
        rest = [0.0] * (len(low) + 1)
        last = len(low)
        while (at := max(low.rfind(BLANK, 0, last), low.rfind(BREAK, 0, last))) >= 0:
            pair, begins = low[at + 1 : at + 3], 0.0
            if pair and pair[0].isalnum():
                begins = min([UNKNOWN, *(x + f for ways in self._next("", 0, pair)[::2] for _, _, _, x, f in ways)])
            rest[: at + 1] = [rest[at + 1] + min(DROP[low[at]], begins)] * (at + 1)
            last = at
        return most, rest

    def _arcs(self, low: str, start: int, best: list[float], enter: float, split: bool, most: float, rest: list[float]) -> Iterator[tuple[int, str, float, bool]]:
        """The vocabulary's words that can be read from a position: (end, word, cost, misread), inside tokens too if they may be split. More misread
        characters are only tried where one reaches no word to the end; what can't lead to a cheaper path than a known one, or than most, is left."""
        words, lower, size, end = self.words, self.lower, len(self.words), len(low)
        layers: list[list[tuple[int, str, int, float, float, bool]]] = [[(start, "", 0, 0.0, self.least, False)], [], []]
        whole = False
        for edits, todo in enumerate(layers):
            if whole:
                break
            while todo:
                at, prefix, first, paid, floor, crossed = todo.pop()
                left = min(best[end], most) + SLACK - enter - paid - rest[at]
                if floor >= left:
                    continue
                c = low[at] if at < end else ""
                if (split or c in STOPS) and prefix and words[first] == prefix and low[at - 1] not in " \n\x02":
                    cost = self.log_total - math.log(lower[prefix]) + paid
                    if enter + cost < best[at]:
                        if edits > 1 and most < best[end]:  # dearer words to the end that rule this one out may have been left
                            yield from self._arcs(low, start, best, enter, split, math.inf, rest)
                            return
                        whole |= at == end and edits > 0
                        yield at, prefix, cost, edits > 0
                if at == end:
                    continue
                if c in " \n\x02":
                    if prefix and not (crossed and c != MARKED):
                        todo.append((at + 1, prefix, first, paid + DROP[c], floor, True))
                        if c == MARKED:
                            p = prefix + "-"
                            i = bisect_left(words, p, first)
                            if i < size and words[i].startswith(p):
                                todo.append((at + 1, p, i, paid, floor, crossed))
                    continue
                if c == "­":
                    todo.append((at + 1, prefix, first, paid, floor, crossed))
                    continue
                got = self._next(prefix, first, low[at : at + 2])
                if edits < MOST_EDITS:
                    after = layers[edits + 1]
                    for k, p, i, x, f in got[edits > 0]:
                        if x + f < left:
                            after.append((at + k, p, i, paid + x, f, crossed))
                for k, p, i, x, f in got[2]:
                    if f < left:
                        todo.append((at + k, p, i, paid, f, crossed))

    def _next(self, prefix: str, first: int, pair: str) -> Moves:
        """Where a prefix can go over the next character or two."""
        known = self.moves.get(pair)
        if known is None:
            known = self.moves[pair] = {}
        got = known.get(prefix)
        if got is None:
            got = known[prefix] = self._moves(prefix, first, pair)
            self.held += 1
        return got

    def _moves(self, prefix: str, first: int, pair: str) -> Moves:
        words, size, c = self.words, len(self.words), pair[0]
        bare = c if c.isascii() else plain(c)
        steps = [(1, m, x, MORE_EDITS) for m, x in CONFUSIONS.get(bare, ())]
        if len(pair) == 2:
            steps += [(2, m, x, MORE_EDITS) for m, x in CONFUSIONS.get(pair, ())]
        if bare != c:
            steps.append((1, bare, ACCENT, ACCENT))
        steps.append((1, c, 0.0, 0.0))
        ways: Moves = ([], [], [])
        for k, letters, x, more in steps:
            p = prefix + letters
            i = bisect_left(words, p, first)
            if i < size and words[i].startswith(p):
                floor = self.log_total - math.log(max(self.counts[i : bisect_left(words, p + LAST, i)]))
                if x:
                    ways[0].append((k, p, i, x, floor))
                    ways[1].append((k, p, i, more, floor))
                else:
                    ways[2].append((k, p, i, x, floor))
        return ways

    def cased(self, word: str, like: str) -> str:
        """word with the capitals of its commonest form that begins in the case of like."""
        first = like[:1].isupper()
        forms = [(n, x) for n, x in self.forms.get(word, ()) if x[:1].isupper() == first]
        if forms:
            return max(forms)[1]
        return word[0].upper() + word[1:] if first else word


def repeated_lines(texts: list[str | None]) -> Counter:
    """How often each short line without inner digits stands in a document."""
    return Counter(line_key(x) for t in texts if t for x in t.split("\n") if 3 < len(x) < 90)


def page_lines(lines: list[str], title: str | None, repeated: Counter) -> list[bool]:
    """Which lines belong to the page: page numbers, running heads (cut titles, names) and notices.

    repeated: how often each line's letters stand alone in a line over the whole document.
    """
    head = re.sub(r"\W+", "", plain(title or "")).lower()
    out = [False] * len(lines)
    stripped = [x.strip() for x in lines]
    for i, s in enumerate(stripped):
        if not s or len(s) > 100 or s[0].islower() and len(s) > 12:
            continue
        if len(s) < 20 and PAGE.fullmatch(s):
            word = re.sub(r"[^a-z]", "", s)
            out[i] = any(c.isdigit() for c in s) or bool(word and ROMAN.match(word)) and (len(word) > 1 or word in "ivx")
            continue
        m = EDGE_NUMBER.match(s) if "  " in s else None
        core = (m[2] or m[3]) if m else s
        if m and (len(core) < 60 and not core.endswith(".") or NOTICE.match(core)):
            out[i] = _is_head(core, head, repeated) or NOTICE.match(core) is not None or len(core.split()) <= 3
            continue
        if NOTICE.match(s) and (repeated[line_key(s)] > 1 or len(s.split()) <= 4):
            out[i] = True
        elif _is_head(core, head, repeated):
            out[i] = True
    # a lone name next to a page number, in a document too short to repeat it
    for i, s in enumerate(stripped):
        if out[i] or not s or not s[0].isupper() or len(s) > 60 or not re.fullmatch(r"[^\W\d_]+(?:[ '-][^\W\d_]+){0,3}(?: et al\.?| and [^\W\d_]+| & [^\W\d_]+)?", s) or len(s.split()) > 4:
            continue
        near = [j for j in range(max(0, i - 2), min(len(lines), i + 3)) if j != i and out[j] and all(not stripped[k] for k in range(min(i, j) + 1, max(i, j)))]
        name = len(s.split()) == 1 or s.endswith(("et al.", "et al"))
        if near and (name or s.isupper()):
            out[i] = True
        elif name and len(s) > 5:  # or inside a sentence
            before = next((x for x in stripped[i - 1 :: -1] if x), "") if i else ""
            after = next((x for x in stripped[i + 1 :] if x), "")
            out[i] = bool(before and after) and len(before) > 2 * len(s) and len(after) > len(s) and not before.endswith((".", "!", "?")) and (after[0].islower() or before[-1:] in HYPHENS or not stripped[i - 1] or not stripped[i + 1])
    return out


def line_key(s: str) -> str:
    """What stays the same of a running head from page to page."""
    return s.strip(" \t0123456789").lower()


def _is_head(s: str, title: str, repeated: Counter) -> bool:
    if len(s) < 4 or not s[0].isupper():
        return False
    cuts = [s]
    if ":" in s and len(s.split(":", 1)[0].split()) <= 4:
        cuts.append(s.split(":", 1)[1])
    for cut in cuts:
        cut = re.sub(r"\W+", "", cut).lower()
        if len(cut) >= 12 and title and sum(map(str.__eq__, cut[:10], title[:10])) >= 4:
            cut = re.sub(r"\W+", "", plain(cut))
            if title.startswith(cut) or _near(cut, title):
                return True
    return repeated[line_key(s)] >= 2 and len(s) < 70 and not any(map(str.isdigit, s)) and not s.endswith((",", ";", *HYPHENS)) and (not s.endswith(".") or s.endswith("et al."))


def _near(cut: str, title: str) -> bool:
    """Whether cut is the title's beginning but for a few misread characters."""
    if abs(len(cut) - len(title)) > len(title):
        return False
    most = max(1, len(cut) // 8)
    row = list(range(len(title) + 1))
    for i, c in enumerate(cut, 1):
        lo, hi = max(1, i - most), min(len(title), i + most)
        new = [99] * (len(title) + 1)
        new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != title[j - 1]))
        if min(new[lo : hi + 1], default=99) > most:
            return False
        row = new
    return min(row[max(0, len(cut) - most) :], default=99) <= most


def paragraphs(lines: list[str], blank_before: list[bool]) -> list[int]:
    """The lines that begin a paragraph, by dynamic programming over all lines.

    A line begins a paragraph or runs on. Both have a cost by what stands around the line end, and a paragraph of one full line that ends no sentence
    costs more; so the state is whether the line before began one.
    """
    n = len(lines)
    if not n:
        return []
    width = max(len(x) for x in lines)
    # cost of the best choices up to a line that runs on, and up to one that begins; with what the line before was
    runs, begins_ = math.inf, 0.0
    came: list[tuple[bool, bool]] = [(True, True)]
    for i in range(1, n):
        before, line = lines[i - 1].rstrip(), lines[i]
        ends, begins = before.endswith((".", "!", "?", ":")), line.lstrip()[:1].isupper() or line.lstrip()[:1].isdigit()
        short = len(before) < 0.75 * width
        join = 3.0 * blank_before[i] + 1.0 * (ends and short) + 0.5 * (line[:1] in " \t")
        cut = 1.5 + 3.0 * (not ends) + 3.0 * (not begins) + 1.0 * (not blank_before[i])
        lone = cut + 1.0 * (not ends and not short)
        came.append((begins_ < runs, begins_ + lone < runs + cut))
        runs, begins_ = join + min(runs, begins_), min(runs + cut, begins_ + lone)
    starts, begun = [], begins_ < runs
    for i in range(n - 1, -1, -1):
        if begun or i == 0:
            starts.append(i)
        begun = came[i][begun]
    return starts[::-1]


class Repairer:
    """Repairs sections with one decoder; what was found for a token with its punctuation is kept."""

    def __init__(self, decoder: Decoder):
        self.decoder = decoder
        self.memo: dict[str, tuple[str, list[str], bool]] = {}
        self.sure: set[str] = set()

    def token(self, raw: str) -> tuple[str, list[str], bool] | None:
        """The token read alone: its text, the words that were misread, and whether it may belong to its neighbours. None for a token that is sure."""
        found, out, at, open_ = [], "", 0, False
        d = self.decoder
        for m in TOKEN.finditer(raw):
            w = m.group()
            digits = sum(map(str.isdigit, w))
            if len(plain(w) if not w.isascii() else w) < 3:
                open_ |= w.isalpha() and w.islower() and not d.known(w)
                continue
            if digits > 2 or digits * 2 > len(w) or digits == 0 and d.cost(w) < SURE:
                continue
            arcs = d.read(w)
            new = "".join(x[2] for x in arcs)
            if new != w and (not w[0].isupper() or " " not in new):
                if any(x[3] for x in arcs):
                    if not _LETTERS.fullmatch(new.replace(" ", "-")):
                        continue
                    found += [x for x in new.split(" ") if x not in w]
                out, at = out + raw[at : m.start()] + new, m.end()
            elif any(c in "|!" for c in w):  # no letter looks like this
                fixed = plain(w).replace("|", "l").replace("!", "l")
                if _LETTERS.fullmatch(fixed):
                    found.append(fixed)
                    out, at = out + raw[at : m.start()] + fixed, m.end()
            else:
                open_ |= w.isalpha() and w.islower() and d.cost(w) > COMMON
        return (out + raw[at:], found, open_) if at or open_ else None

    def joint(self, stream: str) -> tuple[str, list[tuple[str, str]]]:
        """A stretch of tokens read together: its text and the changes it needs."""
        changes: list[tuple[str, str]] = []
        words: list[list] = [["", False, False]]  # text, misread, over a line end
        for a, b, word, misread in self.decoder.read(stream):
            if word in (BLANK, BREAK):
                words.append(["", False, False])
                continue
            w = words[-1]
            w[0] += word
            w[1] |= misread
            w[2] |= BREAK in stream[a:b] or MARKED in stream[a:b]
        for text, misread, over in words:
            if over:
                changes.append(("join", text))
            if misread and _LETTERS.fullmatch(text) and text not in stream:
                changes.append(("fix", text))
        return " ".join(w[0] for w in words), changes

    def section(self, text: str, title: str | None, repeated: Counter, compose: bool = False) -> tuple[list[tuple[str, str]], str]:
        """The changes (kind, item) that a section needs, and its text as continuous paragraphs (empty unless compose)."""
        lines = text.split("\n")
        drop = page_lines(lines, title, repeated)
        changes: list[tuple[str, str]] = [("drop", x.strip()) for x, d in zip(lines, drop, strict=True) if d]
        kept = [i for i, d in enumerate(drop) if not d and lines[i].strip()]
        memo, sure = self.memo, self.sure
        if len(memo) + len(sure) > 300_000:
            memo.clear()
            sure.clear()
        blank = [False] * len(kept)
        for pos in range(1, len(kept)):
            a, b = kept[pos - 1], kept[pos]
            blank[pos] = b - a > 1 and not any(drop[a + 1 : b])
        # The stream: every token with the sign before it and its line; a token that is sure has no entry in doubt.
        raws: list[str] = []
        signs: dict[int, str] = {}  # before the tokens that begin a line; a blank is before all others
        first_of: list[int] = []  # where each line begins
        doubt: dict[int, tuple[str, list[str], bool]] = {}
        for pos, i in enumerate(kept):
            own_tokens, begin = lines[i].split(), len(raws)
            if not sure.issuperset(own_tokens):
                for x, w in enumerate(own_tokens, begin):
                    if w in sure:
                        continue
                    got = memo.get(w) or self.token(w)
                    if got is None:
                        sure.add(w)
                    else:
                        doubt[x] = memo[w] = got
            first_of.append(begin)
            signs[begin] = "" if blank[pos] or not pos else BREAK
            raws += own_tokens
        bound: dict[int, str] = {}  # places of tokens that are read together with the token before, with the sign
        for at in first_of[1:]:
            if signs[at] and (sign := self._line_end(raws[at - 1], raws[at], at, doubt)):
                bound[at] = sign
        for at in doubt:
            for x in (at, at + 1):
                if 0 < x < len(raws) and x not in signs and x not in bound and self._blank(raws[x - 1], raws[x], x, doubt):
                    bound[x] = BLANK
        out: dict[int, str] = {}
        own: dict[int, list[tuple[str, str]]] = {}
        gone: set[int] = set()
        done: set[int] = set()
        for at in sorted(bound):
            if at in done:
                continue
            last = at
            while last + 1 in bound:
                last += 1
            head = _TAIL.search(raws[at - 1].rstrip(HYPHENS) if bound[at] == MARKED else raws[at - 1])
            tail = TOKEN.match(raws[last])
            stream = head[0]
            for x in range(at, last):
                stream += bound[x] + (raws[x].rstrip(HYPHENS) if bound[x + 1] == MARKED else raws[x])
            stream += bound[last] + tail[0]
            done.update(range(at, last + 1))
            new, found = self.joint(stream)
            if new != stream.replace(BREAK, BLANK) or found:
                out[at - 1] = raws[at - 1][: head.start()] + new + raws[last][tail.end() :]
                gone.update(range(at, last + 1))
                own[at - 1] = found
        for at, (new, found, _) in doubt.items():
            if at not in out and at not in gone:
                out[at], own[at] = new, [("fix", x) for x in found]
        changes += [x for at in sorted(own) for x in own[at]]
        if not compose:
            return changes, ""
        starts = paragraphs([lines[i] for i in kept], blank)
        edges = [first_of[p] for p in starts] + [len(raws)]
        parts = [" ".join(out.get(x, raws[x]) for x in range(a, b) if x not in gone) for a, b in zip(edges, edges[1:], strict=False)]
        return changes, "\n\n".join(p for p in parts if p)

    def _line_end(self, last: str, first: str, at: int, doubt: dict) -> str:
        """The sign of a line end whose tokens are to be read together, empty if the lattice is cut there."""
        d = self.decoder
        if last[-1] in HYPHENS and len(last) > 1 and (last[-2].isalnum() or last[-2] in "|!"):
            m = _TAIL.search(last.rstrip(HYPHENS))
            return MARKED if m and not m[0].isdigit() and TOKEN.match(first) else ""
        if not first[0].islower():
            return ""
        a, b = last, first
        if not last.isalpha() or not first.isalpha():  # else the whole tokens are the words
            m, n = _WORD_TAIL.search(last), _WORD_HEAD.match(first)
            if not m or not n or _TAIL.search(last)[0] != m[0] or TOKEN.match(first)[0] != n[0]:
                return ""
            a, b = m[0], n[0]
        whole = d.lower.get((a + b).lower())
        if whole and d.cost(a + b) + DROP[BREAK] < d.cost(a) + d.cost(b):
            return BREAK
        unsure = at in doubt and doubt[at][2] or at - 1 in doubt and doubt[at - 1][2]
        return BREAK if unsure and not whole else ""

    def _blank(self, left: str, right: str, at: int, doubt: dict) -> bool:
        """Whether two tokens of a line are to be read together: one may belong to its neighbours, and nothing stands between them."""
        if not (at in doubt and doubt[at][2] or at - 1 in doubt and doubt[at - 1][2]):
            return False
        if not left.isalpha() and not (m := _WORD_TAIL.search(left)) or not right[0].islower() or not (n := _WORD_HEAD.match(right)):
            return False
        m = _WORD_TAIL.search(left)
        return _TAIL.search(left)[0] == m[0] and TOKEN.match(right)[0] == n[0]


def repair(text: str, title: str | None, repeated: Counter, decoder: Decoder, compose: bool = False) -> tuple[list[tuple[str, str]], str]:
    return Repairer(decoder).section(text, title, repeated, compose)


def vocabulary(docs: DataFrame, sections: str = "sections", least: float = LEAST_SHARE) -> tuple[dict[str, int], int]:
    """The words over all sections of all documents that have at least the share `least` of all words, with their counts, and the number of all words.

    Words that occur once are left out too: such a word can't be told from a misread one. At most 1 / least words are sent.
    """

    def counted(tokens: Counter) -> pa.RecordBatch:
        found = words_of(tokens)
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter = Counter()
        for b in batches:
            for t in b.column(0).flatten():
                if text := t.as_py():
                    tokens.update(whole_tokens(text))
                    if len(tokens) > 500_000:
                        yield counted(tokens)
                        tokens = Counter()
        yield counted(tokens)

    texts = docs.select(F.transform(sections, lambda s: s.text).alias("texts"))
    words = materialize(texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    got = words.where(F.col("n") > max(1.0, least * total)).toArrow()
    return dict(zip(got.column("word").to_pylist(), got.column("n").to_pylist(), strict=True)), total


def repair_documents(docs: DataFrame, scanned: str = "source_kind = 'pdf'", sections: str = "sections", compose: bool = True) -> DataFrame:
    """(key, sec_no INT, text STRING, changes ARRAY<STRUCT<kind, item>>): every section of the documents for which scanned holds.

    docs has key, title and sections (array of structs with text); word counts come from all of its rows. Null or empty sections give
    rows with empty text and no changes; null section lists give no rows; repeated rows repeat. The changes are what p3_found lists:
    join, fix and drop; those of lines first, the others in the order of the text. Blanks that were lost or put into a word change the text only.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary(docs, sections))
    rows = docs.where(scanned).select("key", "title", F.transform(sections, lambda s: s.text).alias("texts")).where("texts is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(Decoder(*sent.value))
        for b in batches:
            keys, numbers, out, kinds, items, ends = [], [], [], [], [], [0]
            for key, title, own in zip(b.column("key").to_pylist(), b.column("title").to_pylist(), b.column("texts"), strict=True):
                texts = own.as_py()
                repeated = repeated_lines(texts)
                for no, t in enumerate(texts):
                    changes, text = repairer.section(t, title, repeated, compose) if t else ([], "")
                    keys.append(key)
                    numbers.append(no)
                    out.append(text)
                    kinds += [k for k, _ in changes]
                    items += [x for _, x in changes]
                    ends.append(len(items))
            changed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(items, pa.string())], ["kind", "item"]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(numbers, pa.int32()), pa.array(out, pa.string()), changed], ["key", "sec_no", "text", "changes"])

    return rows.mapInArrow(run, "key string, sec_no int, text string, changes array<struct<kind:string,item:string>>")


__all__ = ["Decoder", "count_words", "page_lines", "paragraphs", "repair", "repair_documents", "vocabulary"]
