"""Problem 9: abusive, hateful or sexually explicit language, scored on text restored by a noisy channel."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import lru_cache
from itertools import groupby
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.session import cut, spread

# What the channel writes for a letter, besides the letter itself.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
# Letters of other scripts that look like Latin ones.
ALIKE = dict(zip("аеорсухіјѕԁһкмтвнԛԝγονρτυιαεκχΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТУХІЈЅ", "aeopcyxijsdhkmtbhqwyovptuiaekxABEZHIKMNOPTYXABEKMHOPCTYXIJS"))
# Common words by what they mean, in some languages. A class decides nothing: what it weighs, and what classes
# that meet in a sentence weigh, is learned from the labels, from the few weights of PRIOR on.
CLASSES = {
    "insult": (
        "idiot moron imbecile cretin dimwit halfwit dumbass jackass asshole arsehole bastard scumbag dickhead bitch whore slut retard douchebag prick twat wanker cunt motherfucker kys cripple "
        "fucker nitwit numbskull blockhead simpleton dunce degenerate lowlife scum dumbfuck shithead bonehead subhuman untermensch faggot nigger kike "
        "idiota imbecil estupido estupida gilipollas cabron pendejo puta mierda connard connasse abruti salaud salope ordure encule cretino vollidiot arschloch hurensohn trottel schwein wichser fotze "
        "ungeziefer abschaum missgeburt vermine racaille burro otario merda stronzo coglione vaffanculo klootzak eikel"
    ),
    "base": "clown parasite loser trash garbage vermin animal pig rat snake coward liar thief fool worm cockroach leech disease plague filth failure joke dog monkey ape waste disgrace burden pest basura escoria lixo escoria dreck abfall dechet spazzatura",
    "low": (
        "worthless pathetic clueless spineless stupid useless disgusting miserable lazy braindead dumb filthy ugly fat retarded ignorant incompetent inferior repulsive vile stinking rotten hopeless gutless brainless mindless dense daft ashamed shame "
        "inutil inutile nutzlos nutzloser dumm dumme dummes dummer bloed blod blode doof sale asqueroso patetico faul widerlich tonto stupide bete nul"
    ),
    "lewd": "porn porno horny nude nudes tits titties cock pussy boobs blowjob orgasm masturbate masturbating erotic dildo cumshot handjob anal milf xxx fellatio cunnilingus threesome dick penis vagina clit nipple boner gangbang hooker fick ficken polla teta nichon bite",
    "intimate": "sex sexy naked undress undressed lick thigh thighs bed kiss lap clothes underwear bra panties moan thrust suck ride rode came cum hot wet hardcore cam webcam oral mouth breast breasts butt ass booty skin seduce nackt desnuda nue",
    "harm": (
        "kill die dead death choke break smash beat burn hang stab shoot punch hurt strangle drop jump gas bury suffer bleed cut rape murder slaughter crush knife bullet hit slap kick drown poison shot lynch exterminate execute destroy hunt "
        "suicide miss existing exist stopped wish hope matar morir muere sterben stirb verrecke tuer creve mourir umbringen"
    ),
    "body": "finger fingers face head throat neck leg legs bone bones tooth teeth knee knees arm eye eyes kneecap jaw spine kopf gesicht cara tete hals",
    "wits": "brain brains wit wits iq intellect intelligence skull hirn gehirn cerveau cerebro cervello hersens",
    "you": "you your yours yourself urself u ur du dich dir dein deine deiner tu te toi ton ta votre vous usted ti eres sos es bist seid sei sois voce jij je jou",
    "they": "they them their those these he him his she her us everybody everyone somebody anyone people sie ellos ellas ils elles eles essi",
    "people": (
        "people women men girl girls boy boys woman man foreigner foreigners immigrant immigrants migrant migrants refugee refugees gay gays lesbian lesbians queer jew jews muslim muslims christian christians black blacks white whites arab arabs "
        "asian asians disabled elderly blind deaf native natives race tribe breed kind ethnic auslander frauen juden mujeres negros extranjeros femmes etrangers juifs mulheres estrangeiros gente personas persona leute mother mom mutter madre mere"
    ),
    "exclude": (
        "ban banned belong belongs country send deport expel exterminate breed hate hates pure purity inferior lie lies steal ruin "
        "raus weg rausgeworfen echarlos fuera dehors fora largate verschwinde degage desaparece callate gueule fresse maul"
    ),
    "curse": "fuck fucking fucked fuckin shit shitty bullshit damn hell piss pissed crap screw bloody arse stfu wtf goddamn joder putain scheisse verdammt cazzo foda caralho",
    "self": "i me my mine myself i'm i've ich mich mein yo mi je moi mon eu meu",
    "thing": "cache code test tests build builds parser script function loop compiler terminal terminals client server index queue lock bug hack regex api thread process worker pointer column database table file child daemon port binary schema thing machine computer",
    "about": "moderator moderators moderation filter classifier detector blocklist denylist block list abuse abusive hateful toxicity toxic profanity comment comments site sites speech removed policy review labelled labeled reported report spam rating adult rated content flag",
}
# Insults in other scripts, as stems.
OTHER_SCRIPTS = "идиот дурак тупиц мраз ублюд заткнись свол дебил урод сука шлюх 白痴 蠢货 傻瓜 傻逼 滚出 废物 去死 笨蛋 贱人 婊子 馬鹿野 バカ 死ね 消えろ クズ 役立たず 間抜け ゴミ野郎 바보 멍청이 병신 개새끼 미친놈 닥쳐 꺼져라 뒈져 죽어라".split()
#: Classes of what can offend, and of whom it can be aimed at.
OFFENCES, TARGETS = ("insult", "base", "low", "lewd", "intimate", "harm", "exclude", "curse", "wits"), ("you", "they", "people", "learned")
#: The few weights assumed before any label is read; all others start from nothing. Offences count more where they meet somebody
#: or one another, less where they meet a thing, talk about moderation or oneself.
PRIOR = {"c:insult": 2.5, "c:lewd": 2.5, "c:other": 6.0, "c:learned": 1.5, "c:wits": 3.0, "b:<harm> <self>": -3.0}
PRIOR |= {"p:" + "+".join(sorted((a, b))): 1.5 for a in OFFENCES for b in TARGETS}
PRIOR |= {"p:" + "+".join(sorted((a, b))): 0.5 for a in OFFENCES for b in OFFENCES}
PRIOR |= {"p:" + "+".join(sorted((a, b))): -1.0 for a in OFFENCES for b in ("thing", "about")} | {f"p:{a}+self": -1.0 for a in ("base", "insult", "low")}
#: Classes that tell nothing but by what they meet.
CONTEXT = frozenset(("you", "they", "self", "people"))
#: Classes that make no sentence worth a look at what meets in it.
PLAIN = frozenset(("you", "they", "self", "thing", "about"))
# Endings that inflect a word of the classes.
ENDINGS = ("s", "es", "e", "n", "en", "er", "es", "em", "ed", "d", "ing", "in", "y", "ies", "'s", "st", "a", "as", "o", "os")
_STEMS = "|".join(("(?<![а-яё])" if "а" <= x[0] <= "я" else "(?<![ァ-ヺー])" if "ァ" <= x[0] <= "ヺ" else "") + x + ("(?!ンス)" if x == "バカ" else "") for x in OTHER_SCRIPTS)
# stems of alphabets and kana start words, which is no vacation (バカンス)
_ELSEWHERE = re.compile(_STEMS)
_OF: dict[str, tuple[str, ...]] = {}
for _name, _words in CLASSES.items():
    for _w in _words.split():
        _OF[_w] = (*_OF.get(_w, ()), _name)
#: Words that masks may hide, and that code may not: those of the classes that offend by themselves.
HIDDEN = frozenset(f for k in ("insult", "base", "low", "lewd", "curse") for x in CLASSES[k].split() if len(x) > 2 for f in (x, x + "s")) | frozenset("sex naked kill kys die subhuman".split())
SHOWN = frozenset(f for k in ("insult", "lewd", "curse") for x in CLASSES[k].split() if len(x) > 2 for f in (x, x + "s"))
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?|#")
_CODE = re.compile(
    r"(?<!\S)(?:[^\s/\\=<>{}\[\]_]*+(?:[/\\=<>{}\[\]]|_\w)|[^\s.]*+(?:\.(?!\w\w)[^\s.]*+)*+\.\w\w)\S*|\b[A-Za-z]\w*+\(\)|\b[0-9a-f]{16,}\b|\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b"
)
_QUOTED = re.compile(r"`[^`\n]*`")
#: What looks like code and isn't: underscores and tags around words, and letters spaced by underscores.
_EDGES = re.compile(r"(?<![^\W_])_+(?=[^\W_])|(?<=[^\W_])_+(?![^\W_])")
_PIECES = re.compile(r"[^\W_]+(?:[@$!|+€*'’]*[^\W_]+)*[@$|+€*]*|[@$!|+€*]+[^\W_]+")
_HUMPS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_TAGS = re.compile(r"[ \t]?</?(?:[abipqsu]|em|strong|mark|small|big|br|hr|div|span|li|ul|ol|h[1-6]|sub|sup|del|ins|font|blockquote|t[drh]|table)(?:\s[^<>\n]*)?/?>[ \t]*", re.I)
_UNDERSCORED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$€|+!])(?:_(?:[^\W_]|[@$€|+!])){2,}(?![^\W_])")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF])
_SPACED = re.compile(r"(?<![\w.*-])(?:\w([ .\-_*~]{1,2}))(?:\w\1){1,}\w(?![\w*]|['.-]\w)")
_ODD = re.compile(r"(?<![\w@$*])(?=[\w@$!|+€*]*[^\W\d_])[\w@$!|+€*]*(?:[0-9@$!|+€*](?=[\w@$!|+€*]*[^\W\d_])|(?<=[^\W\d_])[0-9@$|€*]|([^\W\d_])\1\1)[\w@$|+€*]*")
_THRICE = re.compile(r"([^\W\d_])\1\1")
#: Compounds (`brain-dead`), one word where the classes know it as one.
_COMPOUND = re.compile(r"[^\W_]+-[^\W_]+")
_STOP = re.compile(r"[.!?。!?][\"'”’»)\]*]*$")
ORDER = 4


class Letters:
    """A character language model of Latin words, by interpolated n-grams of up to four letters.

    grams: counts of n-grams of 1 to 4 letters, where `^` pads a word's start and `$` ends it. The lexicon's words are
    as likely as common ones, or the channel would restore something tamer.
    """

    def __init__(self, grams: Mapping[str, float], lexicon: Iterable[str]) -> None:
        self.counts, self.known = Counter(grams), frozenset(lexicon)
        for w in self.known:
            for x in grams_of(w):
                self.counts[x] += 12.0
        self.under: Counter = Counter()
        for x, n in self.counts.items():
            self.under[len(x), x[:-1]] += n
        self.score = lru_cache(maxsize=1 << 17)(self._score)

    def _score(self, past: str, c: str) -> float:
        """Log probability of c after past (three letters)."""
        p = 1 / 64
        for k in range(1, ORDER + 1):
            ctx = past[len(past) - k + 1 :] if k > 1 else ""
            under = self.under[k, ctx]
            if under:
                weight = under / (under + 4.0)
                p = (1 - weight) * p + weight * self.counts.get(ctx + c, 0.0) / under
        return math.log(p)


def grams_of(word: str) -> list[str]:
    """The n-grams of 1 to 4 letters that end at each letter of a padded word."""
    s = "^" * (ORDER - 1) + word + "$"
    return [s[i - k : i + 1] for i in range(ORDER - 1, len(s)) for k in range(ORDER)]


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of a token what letters it may stand for, with the channel's log cost."""
    out = []
    for c, run in groupby(token):
        n = len(list(run))
        base = [c] if c.isalpha() else list(LEET.get(c, ""))
        if not base:
            continue
        if n == 1:
            out.append([(b, 0.0 if c.isalpha() else -0.3) for b in base])
        elif n == 2 and c.isalpha():
            out.append([(c * 2, 0.0)])
        else:
            out.append([(b * k, -0.5 * k) for b in base for k in range(1, min(n, 2) + 1)])
    return out


def viterbi(steps: Sequence[Sequence[tuple[str, float]]], lm: Letters) -> tuple[str, float]:
    """The likeliest word through a lattice: the best way into every state of three letters, step by step."""
    start = "^" * (ORDER - 1)
    states: dict[str, tuple[float, tuple | None]] = {start: (0.0, None)}  # what was said is a chain, so that long tokens take linear time
    for options in steps:
        after: dict[str, tuple[float, tuple | None]] = {}
        for past, (cost, said) in states.items():
            for letters, channel in options:
                total, at = cost + channel, past
                for c in letters:
                    total, at = total + lm.score(at, c), at[1:] + c
                if at not in after or total > after[at][0]:
                    after[at] = total, (said, letters)
        states = after
    # a whole known word is likelier than its letters say
    told = ((_told(said), cost + lm.score(past, "$")) for past, (cost, said) in states.items())
    return max(((said, cost + (4.0 if said in lm.known else 0.0)) for said, cost in told), key=lambda x: x[1])


def _told(chain: tuple | None) -> str:
    out = []
    while chain is not None:
        chain, letters = chain
        out.append(letters)
    return "".join(reversed(out))


class Channel:
    """Restores obfuscated words, token by token; what a token stands for is remembered."""

    def __init__(self, grams: Mapping[str, float]) -> None:
        self.lm = Letters(grams, {x for x in HIDDEN if x.isascii()})
        self.hidden: dict[tuple[str, str, int], list[str]] = {}
        for w in HIDDEN:
            self.hidden.setdefault((w[0], w[-1], len(w)), []).append(w)
        self.token = lru_cache(maxsize=1 << 16)(self._token)
        self.words = lru_cache(maxsize=1 << 17)(self._words)

    def _token(self, token: str) -> str:
        t = token.lower()
        if t in HIDDEN:
            return t
        if "*" in t.strip("*"):
            # masking hides words that offend: of those with these ends and this length the likeliest
            t = t.strip("*")
            fits = [w for w in self.hidden.get((t[0], t[-1], len(t)), ()) if all(a in ("*", b) for a, b in zip(t, w))]
            return max(fits, key=lambda w: (sum(map(self.lm.counts.__getitem__, grams_of(w))), w)) if fits else token
        steps = lattice(t.rstrip("!|+"))
        word = viterbi(steps, self.lm)[0] if steps else token
        # a number with a letter, or a mention, is a word only if it is one to hide
        numeric = t[0] == "@" or sum(c.isdigit() for c in t) > max(1, len(t) - 2) or re.fullmatch(r"[a-z]{1,2}\d+|\d+[a-z]{1,2}|0x\w+|v\d\w*", t)
        return token if numeric and word not in HIDDEN else word

    def _joined(self, m: re.Match) -> str:
        letters = re.sub(r"[ .\-_*~]", "", m[0]).lower()
        if len(letters) < 3 or not any(c.isalpha() for c in letters):
            return m[0]
        # the article before a spaced word may look like its first letter
        ways = [("", letters)] + ([(letters[0] + " ", letters[1:])] if letters[0] in "ai" and len(letters) > 3 else [])
        read = [(lead, *viterbi(lattice(x), self.lm)) for lead, x in ways]
        known = [x for x in read if x[1] in HIDDEN]
        lead, word, _ = max(known or read[:1], key=lambda x: x[2])
        return lead + word

    def _code(self, m: re.Match) -> str:
        """`#` for code; its words if one of them, decoded, is one to show."""
        parts = _PIECES.findall(_HUMPS.sub(" ", m[0]))
        words = [x.lower() if x.isalpha() and not _THRICE.search(x) else _ODD.sub(lambda o: self.token(o[0]), x).lower() for x in parts]
        if any(w in SHOWN or re.split("['’]", w)[0] in SHOWN for w in words):
            return " ".join(words)
        if len(parts) > 2 and all(len(x.rstrip("!|+*")) == 1 for x in parts):
            return self._spelt("".join(parts)) or "#"
        return "#"

    def _spelt(self, letters: str) -> str | None:
        """The word to hide that spaced letters spell, if they do."""
        steps = lattice(letters.lower().rstrip("!|+*"))
        word = viterbi(steps, self.lm)[0] if steps else ""
        return word if word in HIDDEN else None

    def _words(self, token: str) -> tuple[tuple[str, ...], bool]:
        """(restored words of a token without blanks, whether a sentence ends with it)."""
        bare = token[:-1] if token[-1:] in ".,;:?" else token
        if bare.isalpha() and (bare.islower() or bare[1:].islower() or bare.isupper()) and not _THRICE.search(bare):
            return (bare.lower(),), token[-1:] in (".", "?")
        ends = _STOP.search(token) is not None
        if "_" in token:
            token = _EDGES.sub("", _UNDERSCORED.sub(lambda m: self._spelt(m[0].replace("_", "")) or m[0], token))
        told = _ODD.sub(lambda m: self.token(m[0]), _CODE.sub(self._code, token)).lower().replace("’", "'")
        if "-" in told:
            told = _COMPOUND.sub(lambda m: one if (one := m[0].replace("-", "")) in _OF else m[0], told)
        return tuple(_WORD.findall(told)), ends

    def tidy(self, text: str) -> str:
        """Without accents, invisible characters, look-alikes, tags and quoted code; spaced letters joined to words."""
        plain = text
        if not plain.isascii():
            # composed, as the lists are: width and look-alikes don't count, and kana, Hangul and Cyrillic keep their marks
            plain = re.sub(r"\w+", _latin, unicodedata.normalize("NFKC", plain.translate(_INVISIBLE)))
            if not plain.isascii():
                plain = unicodedata.normalize("NFC", _ACCENTED.sub(r"\1", unicodedata.normalize("NFKD", plain)))
                plain = re.sub("([。!?、,])", r"\1 ", plain)
        plain = _TAGS.sub(" ", plain) if "<" in plain else plain
        plain = _QUOTED.sub("#", plain) if "`" in plain else plain
        return _SPACED.sub(self._joined, plain)

    def sentences(self, text: str) -> Iterator[list[str]]:
        """The restored words of each sentence of a text."""
        words = self.words
        for line in self.tidy(text).split("\n"):
            out: list[str] = []
            for token in line.split():
                found, ends = words(token)
                out += found
                if ends and out:
                    yield out
                    out = []
            if out:
                yield out

    def restore(self, text: str) -> str:
        """The restored words, a sentence a line."""
        return "\n".join(" ".join(x) for x in self.sentences(text))


_ALIKE = {ord(a): b for a, b in ALIKE.items()}
_LOOK = re.compile("[" + "".join(ALIKE) + "]+")
_ACCENTED = re.compile("([^ぁ-ヿ가-힣ᄀ-ᇿа-яА-ЯёЁ])[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
#: The Cyrillic letters that Latin ones are put in place of.
_BACK = {ord(b): a for a, b in zip("аеорсухікмтвн", "aeopcyxikmtbh")}


def _latin(m: re.Match) -> str:
    """A word with look-alikes in Latin letters, unless it is one that OTHER_SCRIPTS lists, be it with Latin look-alikes."""
    word = m[0]
    if word.isascii():
        return word
    mixed = re.search("[A-Za-z]", word)
    low = word.lower()
    if _ELSEWHERE.search(low):
        return word
    if mixed and _ELSEWHERE.search(low.translate(_BACK)):
        return low.translate(_BACK)
    return word.translate(_ALIKE) if mixed or _LOOK.fullmatch(word) else word


class Lexicon:
    """The classes of words, with those that the corpus itself taught (`learned`)."""

    def __init__(self, learned: Iterable[str] = ()) -> None:
        self.learned = frozenset(learned)
        self.classes = lru_cache(maxsize=1 << 16)(self._classes)

    def _classes(self, word: str) -> tuple[str, ...]:
        """The classes of a word, as it stands or without an ending."""
        if word in self.learned:
            return ("learned",)
        if word in _OF:
            return _OF[word]
        if not word.isascii():
            return ("other",) if _ELSEWHERE.search(word) else ()
        if "'" in word:
            return next((_OF[x] for x in word.split("'") if x in _OF), ())
        if len(word) > 4:
            for end in ENDINGS:
                if word.endswith(end):
                    stem = word[: -len(end)]
                    for x in (stem, stem + "e", stem[:-1] if stem[-2:-1] == stem[-1:] else stem):
                        if len(x) > 2 and x in _OF:
                            return _OF[x]
        return ()

    def parts(self, word: str) -> list[str]:
        """A word's own features: itself, its classes, its runs of four letters; none for words of mere context."""
        own = self.classes(word)
        if own and CONTEXT.issuperset(own):
            return []
        s = f"^{word}$"
        grams = [f"g:{s[i : i + 4]}" for i in range(len(s) - 3)] if word.isalpha() and len(word) > 3 else []
        return [f"w:{word}", *(f"c:{k}" for k in own if k not in CONTEXT), *dict.fromkeys(grams)]

    def meetings(self, words: Sequence[str]) -> set[str]:
        """What meets in a sentence: pairs of classes, and neighbours of which one has a class (each word by its first class, if any)."""
        kinds = [self.classes(w) for w in words]
        if all(PLAIN.issuperset(ks) for ks in kinds):
            return set()
        seen = Counter(k for _, ks in {*zip(words, kinds)} for k in ks)
        here = sorted(seen)
        out = {f"p:{a}+{b}" for i, a in enumerate(here) for b in here[i + 1 :]} | {f"p:{k}+{k}" for k, n in seen.items() if n > 1}
        for i in range(len(words) - 1):
            a, b = kinds[i], kinds[i + 1]
            if a or b:
                out.add(f"b:{'<' + a[0] + '>' if a else words[i]} {'<' + b[0] + '>' if b else words[i + 1]}")
        return out

    def features(self, words: Sequence[str]) -> set[str]:
        """All features of a sentence, each once."""
        return {x for w in words for x in self.parts(w)} | self.meetings(words)


class Judge:
    """A logistic model over the words, classes and letter runs of a sentence and over what meets in it."""

    def __init__(self, lexicon: Lexicon, bias: float, weights: Mapping[str, float]) -> None:
        self.lexicon, self.bias, self.weights = lexicon, bias, dict(weights)
        self.pairs = {k: v for k, v in weights.items() if k[0] in "pb"}
        self.word = lru_cache(maxsize=1 << 17)(self._word)

    def _word(self, word: str) -> tuple[float, bool, list[str]]:
        """(what the word itself and its letter runs add, whether meetings count with it, its classes)."""
        own = self.lexicon.classes(word)
        add = sum(self.weights.get(x, 0.0) for x in self.lexicon.parts(word) if x[0] != "c")
        return add, not PLAIN.issuperset(own), [k for k in own if k not in CONTEXT]

    def sentence(self, words: Sequence[str]) -> float:
        """The log odds of one sentence."""
        z, tells, here = self.bias, False, set()
        for w in {*words}:
            add, does, own = self.word(w)
            z += add
            if own:
                here.update(own)
            tells |= does
        for k in here:
            z += self.weights.get(f"c:{k}", 0.0)
        if tells:
            z += sum(map(self.pairs.get, self.pairs.keys() & self.lexicon.meetings(words)))
        return z

    def score(self, sentences: Iterable[Sequence[str]]) -> float:
        """The score of the worst sentence, from 0 to 1."""
        return chance(max((self.sentence(s) for s in sentences), default=-30.0))


def chance(z: float) -> float:
    """Log odds as a number from 0 to 1."""
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(
    snippets: Sequence[tuple[list[list[str]], bool]], lexicon: Lexicon, rarity: Mapping[str, float], rounds: int = 4, steps: int = 150, rate: float = 2.0, pull: float = 0.003, balance: float = 6.0
) -> Judge:
    """The model of reviewed snippets, given as sentences of restored words; without snippets PRIOR stands alone.

    A bad snippet has at least one bad sentence: which, is what the model itself says, round by round, its first guess
    being the one with most prior weight and most words that no harmless snippet has. All sentences of harmless
    snippets are harmless. rarity (see `rarities`) scales the value of a word.
    """
    cells: list[tuple[int, bool, set[str]]] = [(i, bad, lexicon.features(s)) for i, (said, bad) in enumerate(snippets) for s in said]
    names = sorted({f for _, _, fs in cells for f in fs} | set(PRIOR))
    at = {f: i for i, f in enumerate(names)}
    value = np.array([rarity.get(f[2:], 1.0) if f[0] == "w" else 0.3 if f[0] == "g" else 1.0 for f in names])
    rows = np.repeat(np.arange(len(cells)), [len(fs) for _, _, fs in cells])
    cols = np.array([at[f] for _, _, fs in cells for f in fs], dtype=np.int64)
    owner, bad = np.array([i for i, _, _ in cells], dtype=np.int64), np.array([b for _, b, _ in cells], dtype=bool)
    prior = np.array([PRIOR.get(f, 0.0) for f in names])
    w, bias, start, x, tame = prior.copy(), -3.0, -3.0, value[cols], np.zeros(len(names), dtype=bool)
    tame[cols[~bad[rows]]] = True
    hint = np.array([0.3 if f[0] == "w" else 0.0 for f in names]) * ~tame
    for _ in range(rounds if len(cells) else 0):
        z = np.bincount(rows, weights=x * (w + hint)[cols], minlength=len(cells))
        best = np.full(int(owner.max()) + 1, -np.inf)
        np.maximum.at(best, owner, z)
        chosen = ~bad | (z >= best[owner])
        # bad sentences weigh as much as harmless ones, up to `balance` times
        share = np.where(bad, min(balance, max(1.0, (~bad).sum() / max(1, (chosen & bad).sum()))), 1.0) * chosen
        share /= max(1.0, share.sum())
        for _ in range(steps):
            z = np.bincount(rows, weights=x * w[cols], minlength=len(cells)) + bias
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - bad) * share
            w -= rate * (np.bincount(cols, weights=x * err[rows], minlength=len(names)) + pull * (w - prior))
            bias -= rate * (err.sum() + pull * (bias - start))
    return Judge(lexicon, float(bias), {f: float(v * s) for f, v, s in zip(names, w.tolist(), value.tolist()) if abs(v * s) > 1e-4})


def rarities(snippets: Sequence[tuple[list[list[str]], bool]], held: Mapping[str, int], documents: int) -> dict[str, float]:
    """From 0 to 1 for each word of the snippets: how much rarer it is in the corpus than in bad snippets, as log odds.

    held: in how many of the corpus's documents each word is. What the corpus is full of (names, its topics) tells
    nothing however often bad snippets hold it. Words of harmless snippets only count by how rare they are.
    """
    bad = sum(b for _, b in snippets)
    seen = Counter(w for said, b in snippets if b for w in {x for s in said for x in s})
    out = {}
    for w in {x for said, _ in snippets for s in said for x in s}:
        usual = (held.get(w, 0) + 0.5) / (documents + 1)
        x = math.log((seen[w] + 0.5) / (bad + 1) / usual) / 4 if seen[w] else max(0.2, -math.log(usual) / 8)
        out[w] = min(1.0, max(0.0, x))
    return out


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(`w`, `n`): every lower-case Latin word of 2 to 20 letters in the corpus and the documents that hold it."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?<![\p{L}\d_/.])([a-z]{2,20})(?![\p{L}\d_/(])"), F.lit(1)))
    return docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def letter_counts(counts: DataFrame) -> dict[str, float]:
    """Counts of the letter n-grams of all words, a word weighing by the logarithm of its documents.

    Added up as whole numbers by the cluster, so that they are the same in any order; 27 signs give at most half a
    million cells, whatever the corpus.
    """
    s = F.concat(F.lit("^" * (ORDER - 1)), "w", F.lit("$"))
    ends = F.sequence(F.lit(ORDER), F.length("w") + ORDER)
    grams = F.flatten(F.transform(ends, lambda i: F.array(*[F.substring(s, i - k, F.lit(k + 1)) for k in range(ORDER)])))
    cells = counts.select(F.explode(grams).alias("g"), F.round(16 * (1 + F.log1p("n"))).cast("long").alias("n")).groupBy("g").agg(F.sum("n").alias("n"))
    return {r["g"]: r["n"] / 16 for r in cells.collect()}


def score_documents(
    docs: DataFrame, row_id: str, text: str, labels: DataFrame, snippet: str, category: str, keep: Sequence[str] = (), sample: int = 20_000, rounds: int = 2, mostly: float = 0.5, least: float = 0.001
) -> DataFrame:
    """(row_id, *keep, `score`): how surely a text holds abusive, hateful or sexually explicit language, from 0 to 1.

    Each text is restored by a noisy channel (`Channel`): Viterbi decoding of character lattices, where leetspeak,
    spacing, repetition, masking and look-alike letters are what the channel may have done, under a character language
    model of all words of the corpus. Every sentence is scored by a logistic model fitted to the reviewed snippets
    (`fit`); the worst one gives the score.

    The corpus then teaches words that the snippets lack: those of which `mostly` of the documents use them in a bad
    sentence, at least three and a share `least` of all bad ones (which bounds their number by the words of a sentence
    over `least`), become a class of their own, the model is fitted again with it, and all sentences with more evidence
    for than against them are scored again, `rounds` times.

    The labels are reviewed snippets, at most `sample` of them used (a documented bound); `none` is harmless, a null
    category isn't used. Null, empty and blank texts score 0. Repeated rows each come out. Empty tables give no rows,
    and without labels the model is what PRIOR says.
    """
    spark, kinds = docs.sparkSession, dict(docs.dtypes)
    known = labels.filter(F.col(category).isNotNull() & F.col(snippet).isNotNull()).select(snippet, (F.col(category) != "none").alias("bad"))
    counts = cut(word_counts(docs, text))
    grams, documents = letter_counts(counts), docs.count()
    channel = Channel(grams)
    snippets = [(list(channel.sentences(r[0])), r[1]) for r in known.orderBy(snippet, "bad").limit(sample).collect()]

    def held(words: DataFrame) -> DataFrame:
        return counts.join(words, "w", "left_semi")

    own = spark.createDataFrame([(w,) for w in sorted({x for said, _ in snippets for s in said for x in s})], "w string")
    rarity = rarities(snippets, {r["w"]: r["n"] for r in held(own).collect()}, documents)
    judge = fit(snippets, Lexicon(), rarity)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (row_id, *keep)) + ", z double, doubtful array<array<string>>"
    first = spark.sparkContext.broadcast((uuid4().hex, grams, judge.bias, judge.weights))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restored, judged = _model(first)
        for b in batches:
            worst, doubtful = [], []
            for t in b["__text"]:
                z, some = -30.0, []
                for s in restored.sentences(t) if t else ():
                    x = judged.sentence(s)
                    z = max(z, x)
                    if x > judged.bias:
                        some.append(s)
                worst.append(z)
                doubtful.append(some)
            yield pd.DataFrame({c: b[c] for c in (row_id, *keep)} | {"z": worst, "doubtful": doubtful})

    scored = cut(spread(docs.select(row_id, *keep, F.col(text).alias("__text"))).mapInPandas(scan, schema))
    said = scored.filter(F.size("doubtful") > 0).select("doubtful")
    last = judge
    for _ in range(rounds if snippets else 0):
        bad = cut(bad_words(said, last).groupBy("w").agg(F.count("*").alias("n")))
        found = bad.filter("w is null").agg(F.sum("n")).first()[0] or 0
        often = bad.filter(F.col("w").isNotNull() & (F.col("n") >= max(3.0, least * found)))
        learned = often.join(counts.withColumnRenamed("n", "all"), "w").filter(F.col("n") >= mostly * F.col("all"))
        last = fit(snippets, Lexicon(r["w"] for r in learned.select("w").collect()), rarity)
    second = spark.sparkContext.broadcast((last.lexicon.learned, last.bias, last.weights))

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learned, *model = second.value
        judged = Judge(Lexicon(learned), *model)
        for b in batches:
            z = [max(map(judged.sentence, some)) if len(some) else x for some, x in zip(b["doubtful"], b["z"])]
            yield pd.DataFrame({c: b[c] for c in (row_id, *keep)} | {"score": [chance(x) for x in z]})

    return scored.mapInPandas(again, schema.split(", z ")[0] + ", score double")


def bad_words(said: DataFrame, judge: Judge) -> DataFrame:
    """(`w`): each document's words without a class in its bad sentences, once, and a null for each document that has one."""
    shared = said.sparkSession.sparkContext.broadcast((judge.lexicon.learned, judge.bias, judge.weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learned, *model = shared.value
        judged = Judge(Lexicon(learned), *model)
        for b in batches:
            out: list[str | None] = []
            for some in b["doubtful"]:
                worst = [s for s in some if judged.sentence(s) >= 0]
                out += [w for w in {x for s in worst for x in s} if len(w) > 2 and judged.lexicon.classes(w) in ((), ("learned",))]
                out += [None] * bool(worst)
            yield pd.DataFrame({"w": out}, dtype=object)

    return said.mapInPandas(run, "w string")


_MODELS: dict[str, tuple[Channel, Judge]] = {}


def _model(shared) -> tuple[Channel, Judge]:
    """Channel and judge of a broadcast, built once in a worker."""
    name, grams, bias, weights = shared.value
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = Channel(grams), Judge(Lexicon(), bias, weights)
    return _MODELS[name]
