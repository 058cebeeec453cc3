"""Personal information in free text (problem 7).

Method: weak supervision. Wide patterns propose spans; for each span labelers (patterns, gazetteers, context) vote for, against or not
at all. The votes fall into few patterns, whose numbers over all texts are all that expectation-maximisation needs: it estimates
how far each labeler can be trusted, without labels. Its posteriors are summed over all texts by the words around the spans, so that phrases that
announce or rule out personal information are learned from the corpus, and vote in a second round. A logistic classifier over the votes, the
words around a span and its shape is then trained on the posteriors of a bounded sample of spans, and decides every span.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize

#: About how many texts the shape model of surnames is learned from.
SHAPE_TEXTS = 5_000
#: About how many spans of a kind the classifier is fitted on.
SAMPLE_SPANS = 20_000
#: Least share of a kind's spans that stand beside a phrase which votes; so at most 3 / LEAST_CONTEXT phrases of a kind are sent.
LEAST_CONTEXT = 3e-5
#: Least share of all words in small letters that makes a word ordinary; at most 1 / ORDINARY words are sent.
ORDINARY = 2e-5
#: Columns of the classifier for words around spans and shapes.
HASHED = 1 << 18

# Words around personal information, in English, German, French and Spanish.
TITLES = "Mr Mrs Ms Miss Dr Dr. Prof. Professor Herr Frau Mme M. Mlle Sr. Sra. Dra. Mr. Mrs. Ms. Doktor"
GREETINGS = "Dear Hi Hello Hallo Hey Liebe Lieber Geehrte Geehrter Bonjour Cher Chère Estimado Estimada Hola Querido Querida"
BEFORE_PEOPLE = "by with from for to and since as at of an von de à par por".split()
STREETS = "Road|Rd|Street|St|Blvd|Boulevard|Lane|Close|Avenue|Ave|Way|Drive|Dr|Court|Ct|Place|Pl|Square|Sq|Terrace|Crescent|Row|Hill|Gardens|Walk"

_U = r"[A-ZÀ-ÖØ-Þ]"
_TOWN = rf"{_U}[\w'’-]+(?: (?:am|an|im|sur|de|del|la|le|upon|on|der) {_U}[\w'’-]+)?"
_SEP = r"(?:,[ ]?\n?[ ]*|[ ]*\n[ ]*)"
# Every way to write one begins with a digit or a capital letter, which is looked at first; so do the numbers below with theirs.
ADDRESS = re.compile(
    rf"(?=[\dA-ZÀ-ÖØ-Þ])(?:(?:\b(?:Flat|Apt\.?|Apartment|Unit|Suite)[ ]\w+{_SEP})?\b\d+[A-Za-z]?(?:[-–/]\d+[A-Za-z]?)?,?[ \n]{_U}[\w'’-]+[ \n](?:{STREETS})\b\.?{_SEP}{_TOWN}(?:,?[ \n]\d{{4,5}}\b)?"
    rf"|\b(?:(?:Flat|Apt\.?|Apartment|Unit|Suite)[ ]\w+{_SEP})?{_U}[\w'’-]+[ ](?:House|Court|Tower|Hall|Lodge){_SEP}(?:\d+[A-Za-z]?(?:[-–]\d+)?,?[ ])?{_U}[\w'’-]+[ \n](?:{STREETS})\b\.?{_SEP}{_TOWN}(?:,?[ \n]\d{{4,5}}\b)?"
    rf"|\b(?:P\.?[ ]?O\.?[ ]?)?(?:Box|BOX)[ ]\d+{_SEP}{_TOWN}(?:,?[ \n]\d{{4,5}}\b)?"
    rf"|\b(?:(?:Am|An|Im|Zum|Zur|In|Auf|Alte|Neue)[ ](?:der[ ]|dem[ ]|den[ ])?)?{_U}[\w-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm)[ \n]\d+[ ]?[a-z]?(?:[-–]\d+[a-z]?)?{_SEP}(?:[A-Z]{{1,2}}-)?\d{{4,5}}[ \n]{_TOWN}"
    rf"|\b(?:Postfach|Boîte postale|BP|B\.P\.|Apartado(?: de correos)?|Apdo\.?(?: de correos)?)[ ]\d+(?:[ ]\d+)*{_SEP}(?:[A-Z]{{1,2}}-)?\d{{4,5}}[ \n]{_TOWN}"
    rf"|\b\d+[A-Za-z]?(?:[ ](?:bis|ter|quater))?,?[ \n](?:rue|avenue|av\.|boulevard|bd|place|chemin|quai|impasse|allée|cours|route)[ \n](?:(?:de la|de|du|des|d['’]|la|le|les)[ ]?)?{_U}[\w'’-]+{_SEP}(?:F-)?\d{{4,5}}[ \n]{_TOWN}"
    rf"|(?:\b(?:Calle|Avda\.|Avenida|Plaza|Paseo|Camino|Ronda|Travesía)|C/)[ \n]?(?:(?:de la|de los|de las|del|de)[ ])?{_U}[\w'’-]+,?[ \n](?:n\.?º[ ]?)?\d+[A-Za-z]?(?:,[ ]?\d+\.?[ºª°o]\.?(?:[ ][A-Za-z]\b|[ ](?:izq|dcha)\.?)?)?{_SEP}(?:E-)?\d{{4,5}}[ \n]{_TOWN})"
)
# One of these words stands in every address, or one of these ends of a street's name.
ADDRESS_WORDS = f"{STREETS}|Calle|Avda|Avenida|Plaza|Paseo|Camino|Ronda|Travesía|C/|Box|BOX|Postfach|BP|Apartado|Apdo|House|Tower|Hall|Lodge"
ADDRESS_WORDS += "|rue|avenue|av|boulevard|bd|place|chemin|quai|impasse|allée|cours|route|postale|B.P."
STREET_ENDS = "straße|strasse|str|weg|platz|allee|gasse|ring|ufer|damm"
_AT = r"(?:[ ]?@[ ]?|[ ]?[(\[{<][ ]?(?:at|AT|ät|@)[ ]?[)\]}>][ ]?|[ ](?:at|AT)[ ])"
_DOT = r"(?:\.|[ ]?[(\[{<][ ]?(?:dot|DOT|punkt|\.)[ ]?[)\]}>][ ]?|[ ](?:dot|DOT)[ ])"
EMAIL = re.compile(rf"(?<![\w.+%-])[A-Za-z0-9_][\w.+%-]*+{_AT}[A-Za-z0-9][\w-]*+(?:{_DOT}[A-Za-z0-9][\w-]*+)++(?![ ]?@|[ ]?[(\[](?:at|AT)[)\]]|[ ](?:at|AT)[ ]\S+[ ](?:dot|DOT)[ ])")
MAYBE_EMAIL = re.compile(r"@|[(\[{<] ?(?:at|AT) ?[)\]}>]| (?:at|AT) \S+ (?:dot|DOT) ")
_AT_SIGN = re.compile(r"@|[(\[{<][ ]?(?:at|AT|ät|@)[ ]?[)\]}>]|(?<=[ ])(?:at|AT)(?=[ ])")


def _emails_in(text: str) -> Iterator[re.Match]:
    """The matches of EMAIL in order. What stands before an @, or a word for it, is a whole run of signs, so only the beginnings of such runs are tried."""
    if not MAYBE_EMAIL.search(text):
        return
    done = 0
    for sign in _AT_SIGN.finditer(text):
        end = sign.start()
        if text[end - 1 : end] == " ":
            end -= 1
        start = end
        while start and (text[start - 1].isalnum() or text[start - 1] in "_.+%-"):
            start -= 1
        if done <= start < end and (m := EMAIL.match(text, start)):
            yield m
            done = m.end()


PHONE = re.compile(
    r"(?=[\d+(])(?:(?<![\w.+/@$-])(?<!\d[ ])(?:(?:\+|00)\d{1,3}[ ./-]?)?(?:\(0?\d{1,4}\)[ ./-]?)?\d{2,5}(?:[ ./-]\d{2,5}){1,5}(?:,?[ ]?(?:ext\.?|extension|x|Durchwahl|DW|poste|int\.|anexo)[ ]?\d{1,5})?(?![\w/@-])(?!\.\d)"
    r"|(?<![\w.+/@$-])(?:\+|00)\d{1,3}[ ./-]?(?:\(0?\d{1,4}\)[ ./-]?)?\d(?:[ ./-]?\d){5,12}(?:,?[ ]?(?:ext\.?|extension|x|Durchwahl|DW|poste|int\.|anexo)[ ]?\d{1,5})?(?![\w/@-])(?!\.\d)"
    r"|(?<![\w.+/@$-])\(0?\d{2,4}\)[ ]?\d{5,8}(?:,?[ ]?(?:ext\.?|x)[ ]?\d{1,5})?(?![\w/@-]))"
)
ID = re.compile(r"(?=[A-Z\d])(?<![\w/.@+-])(?:[A-Z]{2}[ ]?\d\d[ ]?\d\d[ ]?\d\d[ ]?[A-D]|(?:(?!ID\b|NI\b|HR\b|NO\b|NR\b|PO\b|NR\b|IN\b|AT\b)[A-Z]{1,2}[ -]?)?\d{2,}+(?:[A-Z]{1,2}\d+|[A-Z](?=\b))?(?:[ /-]\d{2,}+){0,4}|[A-Z](?=[A-Z]*\d)[A-Z0-9]{7,10})(?![\w@/-])(?!\.\d)")
WORD = re.compile(rf"\b{_U}[^\W\d_]*(?:['’-][^\W\d_]+)*")
LOWER_NEXT = re.compile(r"[ ](?:([A-Za-z])\.?[ ])?([^\W\d_]+(?:['’-][^\W\d_]+)*)")
DIGITS = re.compile(r"\d[\d()/+.-]*+(?: [\d(][\d()/+.-]*+)*+")
ID_CUE = re.compile(
    r"(?i)(?:passport|passeport|pasaporte|reisepass|ausweis|social security|\bssn\b|tax (?:no|number|id)|steuer|\bni number|\bnino\b|national id|national insurance|insurance n|personnel|personal(?:nummer|-nr)|employee_?id|employee n|staff (?:card|no|id|number)|matric|matrikel"
    r"|student (?:no|id|number|card)|\bid on file|\bpayroll\b|\bhr wants|\bdni\b|\bnie\b|\bnif\b|sécurité sociale|seguridad social|numéro fiscal|carte d.identité|licen[cs]e n|badge|identity (?:card|no|number)|id[- ]card|sozialversicherung|versicherungs|\"(?:employee|staff|student|national)_id\")[^\d\n]{0,24}$"
)
# One of these stands in whatever ID_CUE finds.
ID_STEMS = ("pass", "pasaporte", "ausweis", "social", "ssn", "tax", "steuer", "ni number", "nino", "national", "insurance", "person", "employee", "staff", "matri", "student", "id on file", "payroll", "hr wants", "dni", "nie", "nif", "fiscal", "carte", "licen", "badge", "identity", "id card", "id-card", "versicherung")


def _id_cue(before: str) -> re.Match | None:
    low = before.lower()
    return ID_CUE.search(before) if any(x in low for x in ID_STEMS) else None


ID_AFTER = re.compile(r"(?i)^[ ,)]{0,2}(?:is my|ist meine|est mon|es mi)[ ](?:NI|passport|social|tax|national|staff|student|steuer|DNI)")
NOT_PERSON = re.compile(r"(?i)\b(?:build|run|run id|ticket|checkpoint|grant|grant no|seeds?|isbn\S*|doi|arxiv|figure|table|release|version|issue|commit|order|invoice|box|room)[ :.#=]*(?:[A-Z]{1,2})?$")
PHONE_CUE = re.compile(r"(?i)(?:\bph\.?|phones?|tel\.?|telephone|telefon|teléfono|téléphone|mobile|mobil|móvil|portable|fax|call(?: me)?(?: on| at)?|\bT|office line|\bline|handy|durchwahl|numéro est le|número es el|nummer ist|nummer lautet|reach me(?: on| at)?|ring(?: me)?(?: on| at)?|whatsapp|cell|dial|text me (?:on|at)|by phone)[ :=.]*$")
_TOKENS, _AFTER = re.compile(r"[^\W\d_]+|\d+"), re.compile(r"[^\w\n]{0,3}([^\W\d_]+)")
_SIGNS = " .,;:!?()[]{}<>\"'’|=#/*-–"

# Endings of files, which are no domains here.
FILE_ENDINGS = ("py", "md", "txt", "json", "csv", "cc", "sh", "yaml", "cpp")
_DIGIT = re.compile(r"\d")
_SHAPED = re.compile(rf"{_U}?[a-zß-ÿ]+(?:['’-]{_U}?[a-zß-ÿ]+)*|{_U}+(?:['’-]{_U}+)*")


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


class Shape:
    """How much a word looks like a surname: log odds of its letter triples, against ordinary words."""

    def __init__(self, yes: set[str], no: set[str]):
        for _ in range(3):  # the lists are noisy: words on the wrong side of the middle leave them
            self._fit(yes, no)
            good, bad = {w: self.score(w) for w in yes}, {w: self.score(w) for w in no}
            self.middle = (float(np.median([*good.values()])) + float(np.median([*bad.values()]))) / 2 if good and bad else 9.0
            yes, no = {w for w, x in good.items() if x > self.middle}, {w for w, x in bad.items() if x < self.middle}

    def _fit(self, yes: set[str], no: set[str]) -> None:
        a, b = (Counter(g for w in words for g in self.grams(w)) for words in (yes, no))
        na, nb = a.total() + 1, b.total() + 1
        self.odds = {g: math.log((a[g] + 0.3) / na) - math.log((b[g] + 0.3) / nb) for g in {*a, *b}}

    def score(self, w: str) -> float:
        g = self.grams(w)
        return sum(self.odds.get(x, 0.0) for x in g) / max(len(g), 1)

    @staticmethod
    def grams(w: str) -> list[str]:
        w = f"^{plain(w)}$"
        return [w[i : i + 3] for i in range(len(w) - 2)]

    def __call__(self, w: str) -> bool:
        return len(w) > 3 and self.score(w) > self.middle


_PAIR = re.compile(rf"\b({_U}[a-zß-ÿ]+) (?:{_U}\. )?({_U}[a-zß-ÿ]{{4,}})\b")
_GREETED = re.compile(rf"^(?:{'|'.join(GREETINGS.split())}) ({_U}[a-zß-ÿ]+),", re.M)
_ALONE = re.compile(rf"^({_U}[a-zß-ÿ]+)$", re.M)
_BEGINS = re.compile(r"(?:^|[.!?] )([A-Z][a-z]{3,}) [a-z]")


def count_around_names(rows: DataFrame) -> DataFrame:
    """(kind, word, following, n): what names are learned from, counted over whole texts of rows (text, sampled).

    Kinds are greeted (words after a greeting), alone (words that are a line), pair (capital words and the one that follows) and small (words in small letters) of all texts;
    small, pair and begins (first words of sentences) of the sampled ones are counted again with the prefix s_, for the shape model.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Counter] = defaultdict(Counter)

        def rows_of() -> pd.DataFrame:
            for k in ("small", "s_small"):  # tokens become words only once for each different one
                small: Counter = Counter()
                for token, n in found.pop(k, {}).items():  # parts of addresses and of compounds are no words
                    w = token.strip(_SIGNS)
                    if len(w) > 1 and w.isalpha() and w.islower():
                        small[w] += n
                found[k] = small
            out = [(k, *(w if isinstance(w, tuple) else (w, "")), n) for k, own in found.items() for w, n in own.items()]
            found.clear()
            return pd.DataFrame([(k, x.lower(), y.lower(), n) for k, x, y, n in out], columns=["kind", "word", "following", "n"])

        for b in batches:
            for t, sampled in zip(b.text, b.sampled, strict=True):
                pairs, tokens = _PAIR.findall(t), t.split()
                found["pair"].update(pairs)
                found["small"].update(tokens)
                found["greeted"].update(_GREETED.findall(t))
                found["alone"].update(_ALONE.findall(t))
                if sampled:
                    found["s_pair"].update(pairs)
                    found["s_small"].update(tokens)
                    found["s_begins"].update(_BEGINS.findall(t))
                if sum(map(len, found.values())) > 200_000:
                    yield rows_of()
        yield rows_of()

    counts = rows.select("text", "sampled").mapInPandas(count, "kind string, word string, following string, n long")
    return materialize(counts.groupBy("kind", "word", "following").agg(F.sum("n").alias("n")), "names")


def learn_shape(counts: DataFrame, given: set[str]) -> Shape:
    """The surname shape model, from the counts of the sampled texts and known given names."""
    yes, no, lower = Counter(), Counter(), Counter()
    known = F.col("word").isin(sorted(given)) if given else F.lit(False)
    for r in counts.where(F.col("kind").isin("s_small", "s_begins") | (F.col("kind") == "s_pair") & known).collect():
        if r.kind == "s_pair":
            yes[r.following] += r.n
        else:
            (lower if r.kind == "s_small" else no)[r.word] += r.n
    no.update({w: n for w, n in lower.items() if n >= 3})
    yes = Counter({w: n for w, n in yes.items() if lower[w] <= 2 * n})
    return Shape(set(yes), set(no))


def learn_given(counts: DataFrame, shape: Shape) -> set[str]:
    """Given names over all texts: words that are greeted, or stand before at least five surnames, mostly before surnames, and also alone in a line as under
    a letter; none that stands more often in small letters."""
    sent = counts.sparkSession.sparkContext.broadcast(shape)

    @F.pandas_udf("boolean")
    def like_surname(words: pd.Series) -> pd.Series:
        return pd.Series([sent.value(w) for w in words], dtype=bool)

    def total(kind: str, name: str) -> DataFrame:
        return counts.where(F.col("kind") == kind).select("word", F.col("n").alias(name))

    pairs = counts.where("kind = 'pair'").withColumn("like", like_surname("following")).groupBy("word")
    pairs = pairs.agg(F.sum(F.col("like").cast("int")).alias("surnames"), F.sum(F.when(F.col("like"), F.col("n"))).alias("uses"), F.sum("n").alias("followed"))
    stands = pairs.where("surnames >= 5 and 2 * uses >= followed").select("word", "uses")
    signed = total("alone", "alone").groupBy("word").agg(F.sum("alone").alias("alone"))
    found = total("greeted", "greeted").join(stands, "word", "full").join(total("small", "small"), "word", "left").join(signed, "word", "left").fillna(0)
    cues = {"name", "names"} | {x.lower().strip(".,=:") for x in [*f"{TITLES} {GREETINGS}".split(), *f"{ADDRESS_WORDS}|{STREET_ENDS}".split("|")]}
    return {r.word for r in found.where("(greeted > 0 or alone > 0) and small <= greeted + uses").collect() if r.word not in cues}


def learn_ordinary(counts: DataFrame, least: float = ORDINARY) -> set[str]:
    """The words that make up at least a share of all words in small letters."""
    small = counts.where("kind = 'small'")
    total = small.agg(F.sum("n")).first()[0] or 0
    return {r.word for r in small.where(F.col("n") >= least * total).select("word").collect()}


def around(text: str, a: int, b: int) -> list[str]:
    """The phrases beside a span on its lines: the word before it, the two before it (a number counts as 9), and the word after it; a sign where there is no word."""
    line = text[max(0, a - 48) : a].rsplit("\n", 1)
    before, after = line[-1].rstrip(_SIGNS), text[b : b + 24].lstrip(" ")
    words = ["9" if w[0].isdigit() else w.lower() for w in _TOKENS.findall(before)[-2:]]
    if words:
        out = [] if words[-1] == "9" else [f"<{words[-1]}"]
        if len(words) > 1:
            out.append(f"<{words[0]} {words[1]}")
    else:  # a sign, or the beginning of a line
        out = [f"<{line[-1].rstrip(' ')[-1:]}" if line[-1] else "<\n" if len(line) > 1 else "<"]
    n = _AFTER.match(after)
    out.append(f">{n[1].lower()}" if n else f">{'9' if after[:1].isdigit() else after[:1]}")
    return out


class Finder:
    """Spans of a text with the votes of the labelers and the phrases beside them: (kind, start, end, votes, around), votes a string of +, - and 0."""

    def __init__(self, shape: Shape, given: set[str], ordinary: set[str]):
        self.shape, self.given, self.ordinary = shape, given, ordinary
        self.known: dict[str, int] = {}
        self.givens = ahocorasick.Automaton()
        for w in given:
            self.givens.add_word(w, w)
        self.givens.make_automaton()
        self.hints = ahocorasick.Automaton()
        for w in (*ADDRESS_WORDS.split("|"), *STREET_ENDS.split("|")):
            self.hints.add_word(w, (w, w in STREET_ENDS.split("|")))
        self.hints.make_automaton()
        self.titles, self.greetings = set(TITLES.split()), set(GREETINGS.split())

    def word(self, w: str) -> int:
        """0: nothing, 1: given name, 2: like a surname, 3: one capital letter."""
        c = self.known.get(w)
        if c is None:
            low = w.lower()
            if len(w) == 1:
                c = 3 if w.isupper() else 0
            elif w in self.greetings or w in self.titles:
                c = 0
            elif plain(low) in self.given:
                c = 1
            elif len(w) >= 5 and _SHAPED.fullmatch(w) and all(len(p) > 3 and self.shape(p) for p in re.split(r"['’-]", w)):
                c = 2
            elif "-" in w and w.split("-")[0].lower() in self.given:
                c = 1
            else:
                c = 0
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[w] = c
        return c

    def find(self, text: str) -> list[tuple[str, int, int, str, list[str]]]:
        return [(*x, around(text, x[1], x[2])) for x in self.spans(text)]

    def spans(self, text: str) -> list[tuple[str, int, int, str]]:
        out: list[tuple[str, int, int, str]] = []
        taken: list[tuple[int, int]] = []
        emails = self._emails(text)
        taken += [(a, b) for _, a, b, _ in emails]
        out += emails
        if _DIGIT.search(text):
            for m in self._addresses(text):
                a, b = m.span()
                line = text[a - 1 : a] in ("", "\n") and text[b : b + 1] in ("", "\n")
                out.append(("ADDRESS", a, b, _votes(re.search(r"\d{4,5}$|\d{4,5}[ \n]\S+(?: \S+)*$", m[0]), line or None, re.match(r"\d|Flat|Apt|Apartment|Unit|Suite", m[0]))))
                taken.append((a, b))
            out += self._numbers(text, taken)
        out += self._names(text, taken, [text[a:b] for _, a, b, _ in emails])
        return out

    def _addresses(self, text: str) -> Iterator[re.Match]:
        """Addresses in the stretches between empty lines that hold a word of an address."""
        done = 0
        for at, (word, street_end) in self.hints.iter(text):
            if at < done or text[at + 1 : at + 2].isalpha():
                continue
            if street_end:  # a number follows
                if not text[at + 1 : at + 4].lstrip(". \n")[:1].isdigit():
                    continue
            elif text[at - len(word) : at - len(word) + 1].isalnum():
                continue
            before, end = text.rfind("\n\n", done, at), text.find("\n\n", at)
            start, done = done if before < 0 else before + 2, end if end >= 0 else len(text)
            yield from ADDRESS.finditer(text, start, done)

    def _emails(self, text: str) -> list[tuple[str, int, int, str]]:
        out = []
        for m in _emails_in(text):
            a, b = m.span()
            value = m[0]
            local = re.match(r"[\w.+%-]+", value)[0]
            tail = re.split(r"\W+", value)[-1]
            words = [w for w in re.split(r"[\d._+%-]+", local) if len(w) > 3]
            out.append(
                (
                    "EMAIL",
                    a,
                    b,
                    _votes("@" in value or None, re.search(r"[(\[{]", value), any(self.word(w) for w in words) or any(self.word(w[1:]) == 2 for w in words), tail.isalpha() and len(tail) > 1 and tail.lower() not in FILE_ENDINGS, (tail.isdigit() or tail.lower() in FILE_ENDINGS) and -1, "@" not in value and local.lower() in self.ordinary and -1),
                )
            )
        return out

    def _numbers(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int, str]]:
        out = []
        phones = []
        windows = []
        for m in DIGITS.finditer(text):
            a, b = m.span()
            if sum(map(str.isdigit, m[0])) < 5 and text[a - 1 : a] != "(":
                continue
            if windows and windows[-1][1] >= a - 12:
                windows[-1][1] = b + 14
            else:
                windows.append([max(0, a - 12), b + 14])
        for m in (m for x, y in windows for m in PHONE.finditer(text, x, y)):
            a, b = m.span()
            digits = re.sub(r"\D", "", re.split(r"(?i)[ ,]*(?:ext|x|durch|dw|poste|int|anexo)", m[0])[0])
            if not 9 <= len(digits) <= 15 or _inside(a, b, taken):
                continue
            before = text[max(0, a - 40) : a]
            plus = re.match(r"\+|00[1-9]\d[ .-]?\d", m[0])
            form = re.fullmatch(r"\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?: ext.*)?|0\d{1,4}[ /-]\d{3,}[ ]?\d*|0\d(?:[ .]\d\d){4}", m[0])
            line = text[a - 1 : a] in ("", "\n") and text[b : b + 1] in ("", "\n")
            cue = PHONE_CUE.search(before)
            if not (plus or form or line or cue):
                continue
            ssn = re.fullmatch(r"\d{3}[ -]\d{2}[ -]\d{4}|\d{2,3}[/ ]\d{3}[/ ]\d{5}|(?:19|20)\d\d-\d\d-\d\d|97[89]-.*", m[0])
            other, number = NOT_PERSON.search(before[-18:]), _id_cue(before)
            if number:
                plus = form = None
            out.append(("PHONE", a, b, _votes(plus or None, form or None, cue or None, other and -1, ssn and -1, number and -1, line or None)))
            phones.append((a, b, bool(plus or cue or (form and not other))))
        sure = [(a, b) for a, b, good in phones if good]
        for m in (m for x, y in windows for m in ID.finditer(text, x, y)):
            a, b = m.span()
            value = m[0]
            if sum(map(str.isdigit, value)) < 5 or _inside(a, b, taken):
                continue
            before = text[max(0, a - 48) : a]
            cue, after = _id_cue(before), ID_AFTER.search(text[b : b + 30])
            form = re.fullmatch(r"\d{3}[ -]\d{2}[ -]\d{4}|[A-Z]{2}[ ]?\d\d[ ]?\d\d[ ]?\d\d[ ]?[A-Z]|[A-Z]-\d{5}|[A-Z]{1,2}\d{7,8}|\d\dA[A-Z]\d{5}|\d{2,3}[/ ]\d{3}[/ ]\d{5}", value)
            if not (cue or after or form):
                continue
            other = NOT_PERSON.search(before[-18:])
            out.append(("ID", a, b, _votes(cue or None, after or None, form or None, other and -1, _inside(a, b, sure) and not cue and -1)))
        return out

    def _names(self, text: str, taken: list[tuple[int, int]], emails: list[str]) -> list[tuple[str, int, int, str]]:
        known, word = self.known, self.word
        hits = []
        for m in WORD.finditer(text):
            w = m.group()
            c = known.get(w)
            if c is None:
                c = word(w)
            if c:
                hits.append((m.start(), m.end(), c, w))
        small = self._small_letters(text)
        if small:
            hits = sorted({*hits, *small})
        out = []
        i, n = 0, len(hits)
        while i < n:
            # as long a run as the gaps allow: blanks, an initial's point, one comma
            j = i
            comma = False
            while j + 1 < n:
                gap = text[hits[j][1] : hits[j + 1][0]]
                if gap == " " or (hits[j][2] == 3 and gap in (". ", ".")) or (gap == ", " and not comma and j == i and hits[j][2] == 2 and hits[j + 1][2] in (1, 3)):
                    comma |= gap == ", "
                    j += 1
                    if j - i == 3:
                        break
                else:
                    break
            kinds = [h[2] for h in hits[i : j + 1]]
            if comma and not (text[hits[j][1] : hits[j][1] + 1] == "." and kinds[-1] == 3 or 1 in kinds[1:]):
                j, comma, kinds = i, False, kinds[:1]
            if comma and 2 in kinds[1:]:  # a comma between two persons
                j, comma, kinds = i, False, kinds[:1]
            while kinds and kinds[0] == 3 and len(kinds) == 1 and j == i:
                break
            if all(k == 3 for k in kinds):
                i = j + 1
                continue
            if not comma and kinds[-1] == 3 and text[hits[j][1] : hits[j][1] + 1] != ".":  # a capital letter that is no initial
                while kinds[-1] == 3:
                    j -= 1
                    kinds.pop()
            if not comma and kinds[0] != 2 and 2 in kinds[:-1]:
                kinds = kinds[: kinds.index(2) + 1]
                j = i + len(kinds) - 1
            if not comma and 2 in kinds[:-1] and kinds[0] == 2 and len(kinds) > 1 and not hits[i][3].isupper() and kinds[1] != 3:  # a surname ends a name
                j, kinds = i, kinds[:1]
            a, b = hits[i][0], hits[j][1]
            if kinds[-1] == 3:
                b += 1
            words = [h[3] for h in hits[i : j + 1]]
            i = j + 1
            if _inside(a, b, taken):
                continue
            lower = words[-1][0].islower()
            if lower and not (kinds[0] == 1 and kinds[-1] == 2):
                continue
            if len(kinds) == 1 and kinds[0] == 1 and lower:
                continue
            out.append(("NAME", a, b, self._name_votes(text, a, b, words, kinds, emails)))
        return out

    def _small_letters(self, text: str) -> list[tuple[int, int, int, str]]:
        """The words of names written in small letters: a given name, perhaps an initial, and a word like a surname."""
        hits = []
        for end, w in self.givens.iter(text):
            a, b = end - len(w) + 1, end + 1
            if text[b : b + 1] != " " or text[a - 1 : a].isalnum() or text[a - 1 : a] in ("@", ".", "-", "_", "+", "/") and a:
                continue
            m = LOWER_NEXT.match(text, b)
            if m and m[2][0].islower() and self.word(m[2]) == 2:
                hits.append((a, b, 1, w))
                if m[1]:
                    hits.append((m.start(1), m.end(1), 3, m[1]))
                hits.append((m.start(2), m.end(2), 2, m[2]))
        return hits

    def _name_votes(self, text: str, a: int, b: int, words: list[str], kinds: list[int], emails: list[str]) -> str:
        before = text[max(0, a - 24) : a]
        prev = before.split()[-1] if before.split() and before[-1:] not in ("\n",) else ""
        line_start = before[-1:] in ("", "\n") or before.endswith(("| ", "> "))
        line_end = text[b : b + 1] in ("", "\n") or text[b : b + 2] == " |"
        full = 2 in kinds and len(kinds) > 1
        pair = len(words) == 1 and "-" in words[0] and kinds[0] == 2
        article = prev in ("The", "the", "a", "A", "Das", "Der", "Die", "Le", "La", "El", "St.", "this", "das", "der", "die", "den", "dem", "ein", "eine", "el", "la", "le", "un", "une", "una") and not full
        local = any(plain(w) in e.lower() for w in words if len(w) > 3 for e in emails)
        caseless = "s" if words[-1][0].islower() else "u"
        return _votes(
            full or None,
            prev in self.titles or None,
            prev in self.greetings or None,
            pair and -1,
            article and -1,
            local or None,
            (line_start and line_end) or None,
            kinds[0] == 1 or None,
            prev.lower() in BEFORE_PEOPLE or None,
        ) + caseless + ("p" if text[b : b + 1] in (",", ".", ";", ")", '"', ":") else "n")


def _votes(*votes: object) -> str:
    """+ for true, - for -1, 0 for None and False. Votes count for themselves; letters added behind them describe the span only."""
    return "".join("-" if v == -1 and v is not True else "+" if v else "0" for v in votes)


def _inside(a: int, b: int, spans: list[tuple[int, int]]) -> bool:
    return any(a < y and b > x for x, y in spans)


def aggregate_votes(patterns: dict[str, int], rounds: int = 40) -> dict[str, float]:
    """Posterior that a span with each pattern of votes is real, by expectation-maximisation over the patterns' counts (one class of
    pattern per labeler value: +, -, 0; labelers independent given the class).

    A vote may be weak but never counts for the other side, and a pattern without any vote for it is never more likely real than not.
    """
    longest = max(patterns, key=len)
    blank = re.sub(r"[+-]", "0", longest)
    # The background: as many spans again on which no labeler votes, so that the other class is there even if the patterns propose few wrong spans.
    patterns = patterns | {blank: patterns.get(blank, 0) + sum(patterns.values())}
    keys = list(patterns)
    n = np.array([patterns[k] for k in keys], float)
    symbols = sorted({c for k in keys for c in k})
    x = np.array([[symbols.index(c) for c in k] for k in keys])
    plus, minus = np.array([k.count("+") for k in keys]), np.array([k.count("-") for k in keys])
    p = 1 / (1 + np.exp(-(1.5 * plus - 2.5 * minus - 1.0)))
    for _ in range(rounds):
        prior = np.clip((n * p).sum() / n.sum(), 0.02, 0.98)
        odds = np.full(len(keys), math.log(prior / (1 - prior)))
        for j in range(x.shape[1]):
            for s in range(len(symbols)):
                at = x[:, j] == s
                yes = ((n * p)[at].sum() + 1) / ((n * p).sum() + len(symbols))
                no = ((n * (1 - p))[at].sum() + 1) / ((n * (1 - p)).sum() + len(symbols))
                ratio = math.log(yes / no)
                if symbols[s] == "+":
                    ratio = max(ratio, 1.5)
                elif symbols[s] == "-":
                    ratio = min(ratio, -1.5)
                elif symbols[s] == "0":  # labelers abstain for many reasons
                    ratio = max(ratio, -0.3)
                odds[at] += ratio
        odds = np.where(plus == 0, np.minimum(odds, -0.5 - 2.0 * minus), odds)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(keys, p.tolist(), strict=True))


def phrase_votes(seen: list[tuple[str, int, float]], whole: tuple[int, float]) -> dict[str, float]:
    """Log odds of a phrase beside a span against all spans of the kind, from (phrase, spans, their posteriors' sum), smoothed by four spans like all.

    A phrase whose spans are less sure than the others but still likelier real than not says nothing.
    """
    n, s = whole
    share = min(max(s / max(n, 1), 0.02), 0.98)
    base = math.log(share / (1 - share))
    odds = {p: math.log((t + 4 * share) / (m - t + 4 * (1 - share))) for p, m, t in seen}
    return {p: x - base for p, x in odds.items() if x > base or x < -0.5}


def with_phrases(votes: str, phrases: list[str], odds: dict[str, float]) -> str:
    """votes with one more for what the phrases beside the span say: the two words before it where they are known, else the one, and the word
    after it. For the span if both sides together are and neither is against, against it if both together are; sides that contradict each other say nothing."""
    before = [odds[p] for p in phrases if p[0] == "<" and p in odds][-1:]
    sides = before + [odds[p] for p in phrases if p[0] == ">" and p in odds]
    total, worst = sum(sides), min(sides, default=0.0)
    return ("-" if total < -1.0 else "+" if total > 1.0 and worst > -1.0 else "0") + votes


def _columns(votes: str, phrases: list[str], value: str) -> list[int]:
    """Columns of a span in the classifier: each vote, two neighbouring votes together, the phrases beside it and its shape."""
    shape = _RUN.sub(r"\1", value.translate(_CLASSES))
    parts = [f"v{j}{c}" for j, c in enumerate(votes)] + [f"w{j}{votes[j : j + 2]}" for j in range(len(votes) - 1)] + phrases + [f"s{shape[:24]}"]
    return [_COLUMNS[p] for p in parts]


class _Known(dict):
    """A function's values by argument, emptied when there are many."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, x):
        if len(self) > 300_000:
            self.clear()
        got = self[x] = self.of(x)
        return got


_RUN = re.compile(r"(.)\1+", re.S)
_CLASSES = _Known(lambda c: "9" if chr(c).isdigit() else "A" if chr(c).isupper() else "a" if chr(c).isalpha() else chr(c))
_COLUMNS = _Known(lambda p: xxhash.xxh32_intdigest(p) % HASHED)


class Classifier:
    """Logistic regression over hashed columns, fitted to soft targets by gradient steps with momentum; all spans of a kind with the same columns score the same."""

    def __init__(self, spans: list[tuple[str, list[str], str]], target: list[float], steps: int = 150, ridge: float = 1e-4):
        rows = [_columns(*x) for x in spans]
        at = np.concatenate([np.asarray(r) for r in rows])
        own = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        y = np.asarray(target)
        self.weights, speed = np.zeros(HASHED), np.zeros(HASHED)
        self.base = math.log(max(y.mean(), 0.01) / max(1 - y.mean(), 0.01))
        scale = np.sqrt(np.bincount(at, minlength=HASHED) / len(rows)) + 0.01
        for _ in range(steps):
            odds = self.base + np.bincount(own, self.weights[at], len(rows))
            g = np.bincount(at, (y - 1 / (1 + np.exp(-np.clip(odds, -30, 30))))[own], HASHED) / len(rows) - ridge * self.weights
            speed = 0.8 * speed + 0.5 * g / scale
            self.weights += speed

    def score(self, votes: str, phrases: list[str], value: str) -> float:
        weights = self.listed
        odds = self.base + sum([weights[c] for c in _columns(votes, phrases, value)])
        return 1 / (1 + math.exp(-min(max(odds, -30.0), 30.0)))

    @cached_property
    def listed(self) -> list[float]:
        """The weights as a list: one number at a time comes faster out of it than out of an array."""
        return self.weights.tolist()


SPAN = "struct<kind:string,start:int,end:int,votes:string,around:array<string>,value:string>"


def _candidates(docs: DataFrame, given_names: DataFrame, id_column: str, text: str, shape_texts: int, keep_text: bool) -> DataFrame:
    """(doc_id, spans ARRAY of SPAN, and text if kept), as a table: what the patterns propose in every text, with votes. Texts without a proposal have no row unless kept."""
    spark = docs.sparkSession
    given = {plain(x) for r in given_names.select("formal", "short_form").collect() for x in r if x}  # a fixed table of some dozens
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # a single small file
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    full = rows.where("text is not null and text != ''")
    share = max(1, math.ceil(full.count() / shape_texts))
    counts = count_around_names(full.withColumn("sampled", F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0))
    shape = learn_shape(counts, given)
    sent = spark.sparkContext.broadcast((shape, given | learn_given(counts, shape), learn_ordinary(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*sent.value)
        for b in batches:
            edges, beside, spans, near = [0], [0], [], []
            for t in b.column("text").to_pylist():
                for x in finder.find(t) if t else ():
                    spans.append((*x[:4], t[x[1] : x[2]]))
                    near += x[4]
                    beside.append(len(near))
                edges.append(len(spans))
            kinds, starts, ends, votes, values = zip(*spans, strict=True) if spans else ((),) * 5
            words = pa.ListArray.from_arrays(pa.array(beside, pa.int32()), pa.array(near, pa.string()))
            flat = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(votes, pa.string()), words, pa.array(values, pa.string())], ["kind", "start", "end", "votes", "around", "value"])
            column = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), flat)
            if keep_text:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), column], ["doc_id", "text", "spans"])
            else:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), column], ["doc_id", "spans"]).filter(pa.array(np.diff(edges) > 0))

    kind_of = rows.schema["doc_id"].dataType.simpleString()
    return materialize((rows if keep_text else full).mapInArrow(run, f"doc_id {kind_of}, {'text string, ' if keep_text else ''}spans array<{SPAN}>"), "spans")


def learn(candidates: DataFrame, sample_spans: int = SAMPLE_SPANS) -> dict[str, tuple[dict[str, float], Classifier]]:
    """Of every kind the phrases that vote and the classifier. Votes and phrases are counted over all spans; the classifier is fitted on a hash sample of about
    sample_spans spans of a kind."""
    each = candidates.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    patterns: dict[str, dict[str, int]] = defaultdict(dict)
    for r in each.groupBy("kind", "votes").count().collect():  # at most 3^10 patterns, in practice some hundreds
        patterns[r.kind][r.votes] = r["count"]
    if not patterns:
        return {}
    first = {k: aggregate_votes(v) for k, v in patterns.items()}
    whole = {k: (sum(v.values()), sum(n * first[k][p] for p, n in v.items())) for k, v in patterns.items()}
    spark = candidates.sparkSession
    table = spark.createDataFrame([(k, v, float(p)) for k, own in first.items() for v, p in own.items()], "kind string, votes string, p double")
    least = F.create_map(*[F.lit(x) for k, (n, _) in whole.items() for x in (k, max(2.0, LEAST_CONTEXT * n))])
    beside = each.join(F.broadcast(table), ["kind", "votes"]).select("kind", "p", F.explode(F.array_distinct("around")).alias("phrase"))
    beside = beside.groupBy("kind", "phrase").agg(F.count("*").alias("n"), F.sum("p").alias("s")).where(F.col("n") >= F.element_at(least, F.col("kind")))
    seen: dict[str, list] = defaultdict(list)
    for r in beside.collect():
        seen[r.kind].append((r.phrase, r.n, r.s))
    odds = {k: phrase_votes(seen[k], whole[k]) for k in patterns}
    sent = spark.sparkContext.broadcast(odds)

    @F.pandas_udf("string")
    def voted(kinds: pd.Series, votes: pd.Series, around_: pd.Series) -> pd.Series:
        return pd.Series([with_phrases(v, list(x), sent.value[k]) for k, v, x in zip(kinds, votes, around_, strict=True)], dtype=object)

    second: dict[str, dict[str, int]] = defaultdict(dict)
    for r in each.withColumn("votes", voted("kind", "votes", "around")).groupBy("kind", "votes").count().collect():
        second[r.kind][r.votes] = r["count"]
    target = {k: aggregate_votes(v) for k, v in second.items()}
    every = F.create_map(*[F.lit(x) for k, (n, _) in whole.items() for x in (k, max(1, math.ceil(n / sample_spans)))])
    rows: dict[str, list] = defaultdict(list)
    for r in each.where(F.pmod(F.xxhash64("doc_id", "start", "end"), F.element_at(every, F.col("kind"))) == 0).select("kind", "votes", "around", "value").collect():
        rows[r.kind].append((with_phrases(r.votes, r.around, odds[r.kind]), r.around, r.value))
    # A tiny kind may have no row in the sample; its patterns stand for themselves.
    for k in patterns:
        rows[k] = sorted(rows[k]) or [(v, [], "") for v in second[k]]
    return {k: (odds[k], Classifier(own, [target[k][x[0]] for x in own])) for k, own in rows.items()}


class Judge:
    """Decides spans by the learned phrases and classifiers. A span for which nothing votes is not kept whatever its score."""

    def __init__(self, learned: dict[str, tuple[dict[str, float], Classifier]]):
        self.learned = learned

    def score(self, kind: str, votes: str, phrases: list[str], value: str) -> float:
        odds, classifier = self.learned[kind]
        votes = with_phrases(votes, phrases, odds)
        return classifier.score(votes, phrases, value) if "+" in votes else 0.0


def find_spans(docs: DataFrame, given_names: DataFrame, id_column: str = "doc_id", text: str = "text", shape_texts: int = SHAPE_TEXTS) -> DataFrame:
    """(doc_id, kind STRING, start INT, end INT, value STRING, score DOUBLE): the personal information in every text.

    Kinds are EMAIL, PHONE, ID, ADDRESS and NAME; value is text[start:end] as it stands. given_names is (formal, short_form). Null and
    empty texts give no rows; a row that repeats gives its spans again; the whole text is read whatever its length. The shape of
    surnames is learned from a hash sample of about shape_texts whole texts and the classifier from one of spans; further given names, phrases and votes
    are counted over all texts.
    """
    candidates = _candidates(docs, given_names, id_column, text, shape_texts, False)
    sent = docs.sparkSession.sparkContext.broadcast(learn(candidates))
    each = candidates.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        judge = Judge(sent.value)
        for kinds, votes, around_, values in batches:
            yield pd.Series([judge.score(k, v, list(x), w) for k, v, x, w in zip(kinds, votes, around_, values, strict=True)], dtype=float)

    return each.withColumn("score", score("kind", "votes", "around", "value")).where("score >= 0.5").select("doc_id", "kind", "start", "end", "value", "score")


def replace_spans(text: str, spans: list[tuple[int, int, str]]) -> tuple[str, int]:
    """The text with its spans (start, end, kind) replaced by [KIND], and their number; of overlapping ones the first, then longest, counts."""
    parts, at = [], 0
    for start, end, kind in sorted(set(spans), key=lambda s: (s[0], -s[1], s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*parts, text[at:]]), len(set(spans))


def redact_documents(docs: DataFrame, given_names: DataFrame, id_column: str = "doc_id", text: str = "text", shape_texts: int = SHAPE_TEXTS) -> DataFrame:
    """(doc_id, redacted STRING, n_found INT): every text of docs with what find_spans finds in it replaced. The candidates are kept beside their texts, so nothing
    is shuffled by document. Null texts stay null and empty ones empty; rows that repeat repeat."""
    candidates = _candidates(docs, given_names, id_column, text, shape_texts, True)
    sent = docs.sparkSession.sparkContext.broadcast(learn(candidates))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(sent.value)
        for b in batches:
            out = []
            for t, own in zip(b.text, b.spans, strict=True):
                kept = [(s["start"], s["end"], s["kind"]) for s in own if judge.score(s["kind"], s["votes"], list(s["around"]), s["value"]) >= 0.5]
                out.append(replace_spans(t, kept) if t else (t, 0))
            yield pd.DataFrame({"doc_id": b.doc_id, "redacted": [x[0] for x in out], "n_found": [x[1] for x in out]})

    kind_of = candidates.schema["doc_id"].dataType.simpleString()
    return candidates.mapInPandas(run, f"doc_id {kind_of}, redacted string, n_found int")


def redact(docs: DataFrame, spans: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, redacted STRING, n_found INT): every text with given spans replaced by [KIND], as redact_documents does.

    Null texts stay null and empty ones empty. doc_id must name one text; copies under the same id get the same spans.
    """
    found = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", "kind")).alias("spans"))
    joined = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).join(found, "doc_id", "left")

    @F.pandas_udf("string")
    def replace(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or own is None else replace_spans(t, [(s["start"], s["end"], s["kind"]) for s in own])[0] for t, own in zip(texts, all_spans, strict=True)], dtype=object)

    return joined.select("doc_id", replace("text", "spans").alias("redacted"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_found"))
