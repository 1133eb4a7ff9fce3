"""Broken prompt and response pairs (problem 3).

A multi-label linear classifier on hashed features scores each distinct pair of a question and a response. Its features are
n-grams and shapes of the response's end, with identifiers, numbers and rare words masked, and features of the pair: how much
of the question the response repeats, what it adds, the languages of both, open fences and brackets, and how many words there
are besides those for "nothing". For refusals it scores each sentence by the classes of its words (lexicon.CLASSES: negation,
ability, knowledge, sources and so on), their order, and how much else the sentence says, and the response by its least declining
sentence, since a refusal that goes on to answer is none.

It is trained on a bounded sample of pairs (sample_pairs questions, a parameter; the only bound here). Their sound responses
are kept, stripped of the full stop, prefixed by reservations or by the question, and broken on purpose: truncated, copied,
swapped with a response in another language, refused, or emptied. A fifth of the questions, and a fourth of the refusing sentences,
are held out and set the threshold of each defect, in the middle of the gap between sound and broken examples or where F1 is best.
The words that count as known or whole are counted over all pairs. All pairs are scored, in one narrow map.

A response without any letter or digit, or a null one, is empty by definition; the classifier decides about all others. A null or empty question leaves only the defects that the response shows by itself. Repeated rows of
one question count once. A response gets at most one defect, that with the highest margin over its threshold.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docskein.llm.lexicon import FUNCTION_WORDS, LANGUAGE_OF, PLACEHOLDERS, REFUSALS, RESERVATIONS, WRAPPERS, classes_of
from docskein.session import stage

DEFECTS = ("empty", "truncated", "refusal", "copy", "wrong_language")
#: Hash buckets of the features of pairs, of ends and of sentences, in this order, and the defects that each group may speak for.
SIZES = (1 << 12, 1 << 17, 1 << 15)
OFFSETS = (0, SIZES[0], SIZES[0] + SIZES[1])
DIMENSIONS = sum(SIZES)
EMPTY, REFUSAL = DEFECTS.index("empty"), DEFECTS.index("refusal")
ALLOWED = np.array([[1, 1, 0, 1, 1], [0, 1, 0, 0, 0], [0, 0, 1, 0, 0]], dtype=np.float64)
#: How the copied question is framed; {lead} are the first words of some response.
FRAMES = ("{q}", "{q}", '"{q}"', "> {q}", "**{q}**", "{q} {q}", "{q}\n{q}", "Q: {q}\nA:", "{lead}: {q}", "{lead}: {q}", "{lead} {q}")

TOKEN = re.compile(r"\w+|[^\w\s]")
CODE = re.compile(r"```.*?(?:```|$)", re.S)
QUOTED = re.compile(r"`[^`]*`|“[^”]*”|„[^“]*“|‘[^’]*’|«[^»]*»|\"[^\"]*\"")
SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
LETTERS = re.compile(r"[^\W\d_]+")
WORD = re.compile(r"\w+")
TRAIL = re.compile(r"(?:…|\.{3,}|(?<=\s)[-–—])+$")
IDENTIFIER = re.compile(r"[A-Z0-9]*[A-Z][A-Z0-9]*(?:_[A-Z0-9]*)+|\w*_\w*")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def language(text: str) -> tuple[str, float]:
    """The language with most function words, and the share by which it leads over the next one."""
    score: dict[str, float] = {}
    n = 0
    for w in LETTERS.findall(QUOTED.sub(" ", CODE.sub(" ", text)).lower()):
        of = LANGUAGE_OF.get(w)
        if of:
            n += 1
            for x in of:
                score[x] = score.get(x, 0.0) + 1 / len(of)
    if not n:
        return "", 0.0
    first = max(score, key=score.get)
    return first, (score[first] - max((v for x, v in score.items() if x != first), default=0.0)) / n


def masked_identifier(token: str) -> bool:
    return "_" in token or (len(token) > 3 and token.isupper())


def mask(token: str, known: frozenset) -> str:
    if token.isdigit():
        return "0"
    if masked_identifier(token):
        head = token.split("_")[0].upper()
        return "#" + head if len(head) <= 3 else "#M"
    low = token.lower()
    return low if not low.isalnum() or low in known else "w"


def broken_off(token: str, whole: frozenset) -> bool:
    """Whether a last token looks like part of a word or identifier: neither known nor of a regular shape."""
    if not token.isalnum() and "_" not in token or token.isdigit():
        return False
    tail = token.rsplit("_", 1)[-1].lower()
    if tail in whole:
        return False
    return not tail or "_" not in token or re.fullmatch(r"(?:cv)+|0+", shape(token)) is None


def shape(token: str) -> str:
    """Vowels and consonants of the last part of an identifier or word."""
    return "".join("v" if c in "aeiou" else "0" if c.isdigit() else "c" for c in token.rsplit("_", 1)[-1].lower())


class Features:
    """Hashed features of pairs; known: the words that occur in many texts, whole: all words that more than one text has."""

    def __init__(self, known: frozenset, whole: frozenset):
        self.known, self.whole = known, whole
        self.classes: dict[str, tuple] = {}
        self.asked: tuple = (None, [], frozenset(), ("", 0.0))

    def classes_of(self, word: str) -> tuple:
        if word not in self.classes:
            if len(self.classes) > 200_000:
                self.classes.clear()
            self.classes[word] = classes_of(word)
        return self.classes[word]

    def of_question(self, question: str | None) -> tuple:
        """(question, its words, their set, its language); the last one is kept for the other response."""
        if self.asked[0] is None or self.asked[0] != question:
            own = words_of(question or "")
            self.asked = (question, own, frozenset(own), language(question or ""))
        return self.asked

    def named(self, question: str | None, response: str | None) -> dict[str, float]:
        a = response or ""
        out: dict[str, float] = {"bias": 1.0}
        _, of_q, in_q, (lq, sure_q) = self.of_question(question)
        of_a = words_of(a)
        in_a = set(of_a)
        # how little there is, and whether it only says that there is nothing
        if len(of_a) < 5:
            bare = [w for w in of_a if w.strip("_")]
            out[f"words{len(bare)}"] = 3.0
            kinds = [self.classes_of(w) for w in bare]
            named = sum("nothing" in k for k in kinds)
            about = sum(bool({"info", "say", "not"} & set(k)) and "nothing" not in k for k in kinds)
            asked = sum(w in in_q for w in bare)
            out[f"nothing{min(1, named)}of{len(bare)}"] = 3.0
            out[f"other{len(bare) - named - about}asked{asked}"] = 3.0
            out[f"about{about}of{len(bare)}{a.rstrip()[-1:] == ':'}"] = 2.0
            for w, k in zip(bare, kinds):
                out[f"short {w if len(w) < 3 or k else 'w'}"] = 1.0
        else:
            out["words5"] = 3.0
        if not any(w.strip("_") for w in of_a):
            return out
        # what the response repeats and adds
        if of_q:
            added = [w for w in of_a if w not in in_q]
            out[f"added{min(8, len(added))}"] = 4.0
            out[f"added>{min(12, len(added) // 4)}"] = 2.0
            cover = len(in_q & in_a) / len(in_q)
            out[f"cover{int(cover * 5)}"] = 1.0
            out[f"cover{int(cover * 5)}added{min(8, len(added))}"] = 4.0
            both = "copied" if cover >= 0.75 and len(added) <= max(4, 0.35 * len(of_q)) else "own"
            out[both] = 6.0
            # languages
            la, sure_a = language(a)
            n = len(LETTERS.findall(QUOTED.sub(" ", CODE.sub(" ", a))))
            if lq and la:
                out["same" if lq == la else f"other{min(3, int(4 * min(sure_q, sure_a)))}{'long' if n > 12 else 'short'}"] = 3.0
        plain = CODE.sub(" ", a)
        out[f"sentences{min(4, len([s for s in SENTENCE.split(plain.strip()) if s.strip()]))}"] = 1.0
        # the end
        end = a.rstrip()
        fenced = end.count("```") % 2 == 1
        out["e fence open" if fenced else "e fence closed"] = 4.0 if fenced else 1.0
        trail = TRAIL.search(end)
        if trail and trail.start() and "\n" not in end[trail.start() - 1 : trail.start()]:
            out["e trail"] = 2.0
            end = end[: trail.start()].rstrip()
        out["e last " + (end[-1] if not end[-1].isalnum() else "word")] = 1.0
        line = end.rsplit("\n", 1)[-1].strip()
        stopped = end[-1] in ".!?`)]”’\"»|" or end.endswith("**")
        item = re.fullmatch(r"(?:\d+[.)]|[-*•+])\s*(.*)", line)
        bare = False
        if item:
            left_in = re.sub(r"[*_\s]", "", item.group(1))
            bare = not left_in
            out["e item bare" if bare else "e item colon" if left_in.endswith(":") else "e item full"] = 6.0 if bare else 4.0
        if fenced or bare:
            return out
        out["e stopped" if stopped else "e open"] = 2.0
        sentence = SENTENCE.split(line)[-1]
        raw = TOKEN.findall(sentence)
        masked = [mask(t, self.known) for t in raw]
        mark = "." if stopped else ""
        if masked and broken_off(raw[-1], self.whole):
            masked[-1] += "?"
        body = masked[:-1] if stopped and masked and not masked[-1].isalnum() and not masked[-1].startswith("#") else masked
        for n in range(1, 7):
            if len(body) >= n:
                out[f"e {n}{mark}{' '.join(body[-n:])}"] = 1.0
        for a, b in ((4, 3), (3, 2), (3, 3)):  # the same with a gap
            if len(body) >= a:
                gap = body[-a:]
                gap[-b + 1] = "*"
                out[f"e gap{mark}{' '.join(gap)}"] = 1.0
        if len(body) >= 6:
            out[f"e ends{mark}{' '.join(body[-6:-2])} * *"] = 1.0
        if not stopped:
            out["e whole " + " ".join(body)] = 3.0
            out[f"e tokens{min(6, len(body))}"] = 1.0
            if raw:
                t = raw[-1]
                if "_" in t:
                    tail = t.rsplit("_", 1)[-1].lower()
                    out[f"e id {mask(t, self.known)} {shape(t)}"] = 2.0
                    out[f"e idpart {tail if tail in self.whole and len(t.split('_')) > 2 else '?'} {min(4, len(t.split('_')))}"] = 1.0
                elif t.isdigit():
                    out["e number end"] = 1.0
                elif t.isalnum():
                    out["e known" if t.lower() in self.whole else "e part"] = 2.0
                else:
                    out[f"e sign {t}"] = 2.0
            for x, y in ("()", "“”", "‘’", "[]", "„“"):
                if sentence.count(x) > sentence.count(y):
                    out["e unclosed"] = 2.0
            if sentence.count("`") % 2 or sentence.count("**") % 2:
                out["e unclosed"] = 2.0
        return out

    def sentence(self, text: str, asked: frozenset) -> dict[str, float]:
        """What a sentence is about, in which order, and how much it says besides."""
        out: dict[str, float] = {"bias": 1.0}
        seen: set[str] = set()
        before: tuple = ("start",)
        fresh = repeated = identifiers = classed = 0
        for token in WORD.findall(text):
            low = token.lower()
            if token.isdigit() or masked_identifier(token):
                identifiers += 1
                continue
            kinds = self.classes_of(low)
            if kinds:
                classed += 1
                seen.update(kinds)
                for x in before:
                    for y in kinds:
                        out[f"{x}>{y}"] = 0.5
                before = kinds
            elif low in LANGUAGE_OF or len(low) < 3:
                continue
            elif low in asked:
                repeated += 1
            else:
                fresh += 1
        for x in seen:
            out["has " + x] = 1.0
        ordered = sorted(seen)
        for i, x in enumerate(ordered):
            for y in ordered[:i]:
                out[f"{y}&{x}"] = 0.5
        denies = bool(seen & {"not", "decline", "beyond"})
        out[f"fresh{min(6, fresh)}"] = 2.0
        out[f"fresh{min(6, fresh)}denies{denies}"] = 3.0
        out[f"repeated{min(3, repeated)}"] = 0.5
        out[f"identifiers{min(2, identifiers)}"] = 0.5
        out[f"classed{min(5, classed)}of{min(5, classed + fresh + repeated)}"] = 1.0
        return out

    def sentences(self, question: str | None, response: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Hashed features of each sentence that has words; code is a sentence of its own kind."""
        asked = self.of_question(question)[2]
        text = response or ""
        found = [self.sentence(x, asked) for x in SENTENCE.split(CODE.sub("\n", text).strip()) if re.search(r"\w", x)]
        if "```" in text:
            found.append({"bias": 1.0, "code": 6.0})
        return [self._hashed(x, 2) for x in found]

    def hashed(self, question: str | None, response: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self._hashed(self.named(question, response), 0)

    def _hashed(self, named: dict[str, float], group: int) -> tuple[np.ndarray, np.ndarray]:
        at = []
        for name in named:
            own = group or name.startswith("e ")
            at.append(OFFSETS[own] + zlib.crc32(name.encode("utf-8", "replace")) % SIZES[own])
        return np.array(at, np.int64), np.fromiter(named.values(), np.float64, len(named))


def _sound(text: str | None) -> bool:
    """Whether a response can stand for a whole one: closed, with sentences, and not short."""
    end = (text or "").rstrip()
    return len(end) > 60 and len(words_of(end)) > 8 and end[-1] in ".!?`" and end.count("```") % 2 == 0


def _filled(rng: random.Random, sentence: str, question: str) -> str:
    """A sentence with an identifier or a word of the question for {x}."""
    names = IDENTIFIER.findall(question) + [w for w in re.findall(r"[^\W\d_]{5,}", question)]
    return sentence.replace("{x}", rng.choice(names or ["this"]))


def broken_examples(pairs: list[tuple], refusals: dict, seed: int = 7) -> list[tuple[str | None, str | None, str | None]]:
    """(question, response, defect or null) made of (question, response) pairs; refusals: the sentences to use, by language."""
    rng = random.Random(seed)
    out: list[tuple] = []
    sound = [(q, a.strip()) for q, a in pairs if q and q.strip() and _sound(a)]
    sound = [(q, a) for q, a in sound if language(q)[0] == language(a)[0] != ""]
    by_language: dict[str, list[str]] = {}
    for _, a in sound:
        lead, sure = language(a)
        if sure > 0.3:
            by_language.setdefault(lead, []).append(a)
    for q, a in sound:
        lang = language(q)[0]
        own = lang if lang in refusals else "en"
        out.append((q, a, None))
        bare = a.rstrip(" .!")
        if bare and a[-1] in ".!":
            out.append((q, bare, None))
            # sound responses that end earlier, at the end of a sentence, with or without its stop
            ends = [m.start() for m in re.finditer(r"(?<=[.!?])\s", a) if a[: m.start()].count("```") % 2 == 0]
            if ends:
                cut = a[: rng.choice(ends)]
                out += [(q, cut.rstrip(" ."), None), (q, cut, None)]
        # truncated: in a word or between words, but not where a sentence ends
        for _ in range(3):
            at = rng.randrange(max(15, len(a) // 5), max(16, len(a) - 3))
            if rng.random() < 0.6:
                at = a.rfind(" ", 0, at)
            cut = a[:at].rstrip() if at > 10 else ""
            tail = re.sub(r"^[\s.!?…`*)\]”’]+", "", a[at:])
            inside = cut.count("```") % 2 == 1
            if cut and (inside or (cut[-1] not in ".!?…`)”" and len(tail) > 2 and not re.match(r"\s*[.!?\n]", a[at:]))):
                out.append((q, cut + ("" if inside or rng.random() < 0.8 else rng.choice(("…", "...", " -", " …"))), "truncated"))
        marks = [m.end() for m in re.finditer(r"(?m)^(?:\d+[.)]|[-*•])\s*(?:\*\*|`[^`\n]+`:)?", a)]
        if len(marks) > 1:
            out.append((q, a[: rng.choice(marks[1:])].rstrip(), "truncated"))
        elif "```" not in a and rng.random() < 0.2:
            k = rng.randrange(2, 6)
            out.append((q, f"{a}\n{rng.choice((f'{k}.', f'{k}.', f'{k})', f'{k}. **', '-', '- **', '*'))}", "truncated"))
        # copied
        asked = rng.choice((q, q, q.strip(" ?¿."), q.upper(), q.lower(), q.replace("?", ".")))
        if rng.random() < 0.3:
            words = asked.split()
            if len(words) > 5:
                words.pop(rng.randrange(len(words)))
            asked = " ".join(words)
        lead = " ".join(rng.choice(sound)[1].split()[: rng.randrange(1, 4)])
        out.append((q, rng.choice(FRAMES).replace("{lead}", lead).replace("{q}", asked.strip()), "copy"))
        out.append((q, f"{q.strip()}\n{a}", None))
        # refused, by one sentence or more, and reserved but answered
        said = [_filled(rng, rng.choice(refusals[own]), q) for _ in range(rng.choice((1, 2, 2, 3)))]
        out.append((q, " ".join(said), "refusal"))
        out.append((q, " ".join([said[0]] * rng.choice((1, 1, 1, 2))), "refusal"))
        out.append((q, f"{_filled(rng, rng.choice(RESERVATIONS[own]), q)} {a}", None))
        if rng.random() < 0.15:
            out.append((q, f"{said[0]} {a}", None))
        # swapped for a response in another language
        others = [x for x in by_language if x != lang]
        if others:
            out.append((q, rng.choice(by_language[rng.choice(others)]), "wrong_language"))
        # empty, and short but an answer
        if rng.random() < 0.5:
            said = rng.choice(WRAPPERS).format(rng.choice(("", "", *PLACEHOLDERS)))
            out.append((q, rng.choice((said, said, said.upper(), said.title(), rng.choice(("", " ", "\n", "...", "…", "-", "--", "{}", "\u200b", "\u00a0", "\ufeff", "?", "|")))), "empty"))
        if rng.random() < 0.5:
            names = IDENTIFIER.findall(a) or re.findall(r"\w{4,}", a)
            out.append((q, rng.choice((rng.choice(names), f"`{rng.choice(names)}`", f"{rng.choice(names)}.", str(rng.randrange(1000)), rng.choice(re.findall(r"[^\W\d_]{4,}", a)))), None))
    return out


class Classifier:
    """Weights of each defect, thresholds, and the word lists of the features."""

    def __init__(self, pairs: list[tuple], known: frozenset, whole: frozenset, epochs: int = 6, rate: float = 0.25, seed: int = 7):
        self.features = Features(known, whole)
        rng = np.random.default_rng(seed)
        self.declining = np.zeros((DIMENSIONS, 1), dtype=np.float64)
        self.weights = np.zeros((DIMENSIONS, len(DEFECTS)), dtype=np.float64)
        self.thresholds = np.zeros(len(DEFECTS))
        self.held_out: dict[str, float] = {}
        kept = list(pairs)
        shuffled = rng.permutation(len(kept))
        held, train = ([kept[i] for i in part] for part in (shuffled[: len(kept) // 5], shuffled[len(kept) // 5 :]))
        said = {lang: ([x for i, x in enumerate(lines) if i % 4], list(lines[::4])) for lang, lines in REFUSALS.items()}
        learnt, unseen = ({lang: parts[i] for lang, parts in said.items()} for i in (0, 1))
        # Responses of the sample that decline already are no sound ones: a first pass, on long responses only, finds them.
        for least in (4, 1):
            self.declining[:] = 0
            rows, declines = self._sentence_examples(train, learnt, least, random.Random(seed))
            _fit(self.declining, rows, declines[:, None], epochs, rate, rng, None)
            train, held = ([(q, a) for q, a in part if self._declines(q, a) <= 0] for part in (train, held))
        examples = broken_examples(train, learnt, seed)
        if examples:
            target = np.array([[d == x for x in DEFECTS] for _, _, d in examples], dtype=np.float64)
            _fit(self.weights, [self.features.hashed(q, a) for q, a, _ in examples], target, epochs, rate, rng, lambda own: ALLOWED[np.searchsorted(OFFSETS, own, side="right") - 1])
        tests = broken_examples(held, unseen, seed + 1)
        score = np.array([self._score(q, a) for q, a, _ in tests]).reshape(len(tests), len(DEFECTS))
        for k, name in enumerate(DEFECTS):
            self.thresholds[k], self.held_out[name] = _threshold(score[:, k], np.array([d == name for _, _, d in tests], dtype=bool))
        self.weights[:, REFUSAL] = self.declining[:, 0]
        self.weights, self.declining = self.weights.astype(np.float32), self.declining.astype(np.float32)

    def _sentence_examples(self, pairs: list[tuple], refusals: dict, least: int, rng: random.Random) -> tuple[list, np.ndarray]:
        """Sentences of responses with at least so many sentences, and reservations, against sentences that decline."""
        rows, declines = [], []
        for q, a in pairs:
            if not q or not _sound(a):
                continue
            own = self.features.sentences(q, a)
            if len(own) >= least:
                chosen = rng.sample(own, min(len(own), 2))
                rows += chosen
                declines += [False] * len(chosen)
            lang = language(q)[0]
            lang = lang if lang in refusals else "en"
            for lines, flag in ((refusals[rng.choice((lang, *refusals))], True), (RESERVATIONS[rng.choice((lang, *RESERVATIONS))], False)):
                for x in self.features.sentences(q, _filled(rng, rng.choice(lines), q)):
                    rows.append(x)
                    declines.append(flag)
        return rows, np.array(declines, dtype=np.float64)

    def _score(self, question: str | None, response: str | None) -> np.ndarray:
        at, value = self.features.hashed(question, response)
        out = value @ self.weights[at]
        out[REFUSAL] = self._declines(question, response)
        return out

    def _declines(self, question: str | None, response: str | None) -> float:
        """A refusal declines in each of its sentences."""
        return min((float(v @ self.declining[i, 0]) for i, v in self.features.sentences(question, response)), default=-10.0)

    def margins(self, question: str | None, response: str | None) -> np.ndarray:
        return self._score(question, response) - self.thresholds

    def defect(self, question: str | None, response: str | None) -> tuple[str | None, float]:
        """(defect, margin over its threshold), or null and the highest (negative) margin."""
        if not any(w.strip("_") for w in words_of(response or "")):
            return "empty", max(0.0, float(self.margins(question, response)[EMPTY]))
        m = self.margins(question, response)
        best = int(np.argmax(m))
        return (DEFECTS[best] if m[best] > 0 else None), float(m[best])


def _fit(weights: np.ndarray, rows: list, target: np.ndarray, epochs: int, rate: float, rng, allowed, batch: int = 160) -> None:
    """Logistic regressions on sparse rows by Adagrad; allowed(features) masks the gradient."""
    if not len(rows):
        return
    seen = np.full(weights.shape, 1e-2)
    batches = []
    for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
        at = np.concatenate([rows[i][0] for i in part])
        value = np.concatenate([rows[i][1] for i in part])
        size = np.array([len(rows[i][0]) for i in part])
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.diff(at[order], prepend=-1))
        own = at[order][starts]
        batches.append((at, value, size, order, starts, own, target[part], None if allowed is None else allowed(own)))
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            at, value, size, order, starts, own, truth, mask_ = batches[k]
            score = np.add.reduceat(weights[at] * value[:, None], np.cumsum([0, *size[:-1]]), axis=0)
            wrong = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - truth
            step = np.repeat(wrong, size, axis=0) * value[:, None] / len(size)
            gradient = np.add.reduceat(step[order], starts, axis=0)
            if mask_ is not None:
                gradient *= mask_
            seen[own] += gradient**2
            weights[own] -= rate * gradient / np.sqrt(seen[own])


def _threshold(score: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """(threshold, its F1): midway between nearly all sound and nearly all broken examples where these are apart, else where F1 is best."""
    if not truth.any() or truth.all():
        return 0.0, 0.0
    order = np.argsort(-score)
    s, t = score[order], truth[order]
    f1 = 2 * np.cumsum(t) / (np.arange(1, len(t) + 1) + t.sum())
    best = int(np.argmax(f1))
    high, low = np.quantile(score[~truth], 0.997), np.quantile(score[truth], 0.02)
    at = (high + low) / 2 if high < low else (s[best] + s[best + 1]) / 2 if best + 1 < len(s) else s[best] - 1
    over = score > at
    return float(at), float(2 * (over & truth).sum() / max(1, over.sum() + truth.sum()))


def response_pairs(df: DataFrame) -> DataFrame:
    """question_id, question, open_source, closed_source: one row for each question."""
    return df.groupBy("question_id").agg(
        F.max(F.trim("question")).alias("question"), F.max("open_source_response").alias("open_source"), F.max("closed_source_response").alias("closed_source")
    )


def word_lists(pairs: DataFrame) -> tuple[frozenset, frozenset]:
    """(known, whole): words of at least 0.4 % of the texts, and the parts of words of at least two texts and one in 50,000.

    Counted over all questions and responses. A text of m words adds to at most m counts, so the lists are bounded by 250 and
    50,000 times the mean number of words of a text, whatever the number of texts.
    """
    texts = pairs.select(F.explode(F.array("question", "open_source", "closed_source")).alias("text")).where(F.length("text") > 0)
    total = texts.count()
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))).alias("word"))
    rows = words.groupBy("word").count().where(F.col("count") >= max(2, total / 50_000)).toPandas()
    often = rows[rows["count"] >= max(3, 0.004 * total)]
    short = {w for lang in FUNCTION_WORDS.values() for w in lang.split()}
    return frozenset(w for w in often.word if "_" not in w and not w.isdigit()) | short, frozenset(p for w in rows.word if not w.isdigit() for p in w.split("_"))


_FITTED: dict[int, Classifier] = {}


def fitted(pairs: DataFrame, sample_pairs: int) -> Classifier:
    """The classifier of a table of response_pairs; the last one is kept, so that queries on the same rows don't fit it again."""
    sample = pairs.orderBy(F.xxhash64("question_id"), "question_id").limit(sample_pairs).collect()
    known, whole = word_lists(pairs)
    key = hash((tuple((r.question, r.open_source, r.closed_source) for r in sample), known, whole))
    if key not in _FITTED:
        _FITTED.clear()
        _FITTED[key] = Classifier([(r.question, a) for r in sample for a in (r.open_source, r.closed_source)], known, whole)
    return _FITTED[key]


def broken_pairs(df: DataFrame, sample_pairs: int = 1500) -> DataFrame:
    """question_id, side, defect, margin: each broken response of evaluation results."""
    pairs = stage(response_pairs(df), "pairs")
    model = df.sparkSession.sparkContext.broadcast(fitted(pairs, sample_pairs))
    kind = pairs.schema["question_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            ids, questions, *sides = (batch.column(i) for i in range(4))
            at, names, defects, margins = [], [], [], []
            questions = questions.to_pylist()
            for name, side in zip(("open_source", "closed_source"), sides):
                for k, (q, a) in enumerate(zip(questions, side.to_pylist())):
                    defect, margin = own.defect(q, a)
                    if defect:
                        at.append(k)
                        names.append(name)
                        defects.append(defect)
                        margins.append(margin)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(defects, pa.string()), pa.array(margins, pa.float64())], ["question_id", "side", "defect", "margin"])

    return pairs.select("question_id", "question", "open_source", "closed_source").mapInArrow(scan, f"question_id {kind}, side string, defect string, margin double")
