"""Broken prompt and response pairs.

A multi-label linear classifier on hashed n-grams and pair features tells what is wrong with a response:
empty, truncated, refusal, copy or language. It is fitted on a bounded sample of the pairs themselves,
taken as sound, and on defects made from them: responses cut off, copied from the prompt, swapped with
those of another language, refused or emptied. Thresholds are calibrated on pairs held out of the fit.
"""

from __future__ import annotations

import html
import pickle
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.linear import BITS, MARK, LinearModel, indices

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")

#: The classifier is fitted on at most so many distinct pairs, chosen by hash; statistics beyond that are not used.
SAMPLE_PAIRS = 12_000
#: Longer pairs are judged but not fitted on, which bounds the sample in bytes too.
SAMPLE_CHARS = 20_000
FOLDS, ROUNDS = 3, 2
#: The classifier is the mean of so many, each fitted on a share of the made pairs.
BAG = 3
#: Share of the made pairs that each of them is fitted on.
BAG_SHARE = 0.7
#: Features of the sample are made in so many tasks.
TASKS = 12
#: Smaller samples are gone through several times, so that of at least so many pairs others are made.
MADE_OF = 800
#: So many empty responses are made of each stand-in at least.
STAND_IN_TIMES = 8
#: Score from which a pair of the sample is left out of the fit, by defect.
SUSPECT = {"empty": 0.3, "truncated": 0.7, "refusal": 0.1, "copy": 0.3, "language": 0.3}
SEED = 7
#: n-grams of so many first tokens are told from those of the middle and of the last sentence.
HEAD = 14
#: Share of defective pairs for which thresholds are calibrated.
PREVALENCE = 0.03
TOLERANCE = 0.01
#: Share of the sample's pairs that a truncated one is made of; more would outweigh sound responses without a full stop.
TRUNCATED_SHARE = 0.4

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is was were are that it for on with as by at from this but not be or an which had has have its after before when what how why who does did than they so can may cannot it's only most both there will a while one each every more fewer should over about between",
    "de": "der die das und ist nicht mit von zu den dem des ein eine einen einer im am auf für wurde wurden war sich auch nach bei aus als noch nur weil da aber sobald mehr wie was warum welche kann über zum zur gab es sind hat haben kurz durch wird dass diese dieser wenn viele",
    "fr": "le la les et est des du une un dans pour que qui il elle en sur pas par au aux avec ce cette sont était mais plus ne se sa son été avait reste reçu puis quand car après sous pourquoi combien dire ont peu très aussi même entre leur ces vous chez veut mots a restait",
    "es": "el la los las y es de del un una en que por con para se su no al como más pero fue son está ha muy también cuando porque ya sobre entre qué cuántas si tuvo sigue siendo solo después aunque pocas palabras hay hubo este esta ese eso esto durante",
    "it": "il lo la gli le e è di del della un una in che per con non si da al sono ma come più anche questo era perché nel alla quando dopo",
    "pt": "o a os as e é de do da um uma em que por com para se não no na ao mais mas foi são está também quando porque já entre depois",
    "nl": "de het een en van is in op te dat met voor niet zijn aan door er maar ook als bij uit naar dan nog werd omdat wordt na",
    "pl": "i w na z do nie się jest to że o jak po ale za od przez dla był była oraz tym gdy już tylko są ponieważ",
    "sv": "och att det i en som på är av för med den till inte om ett men var har från eller när efter också bara",
    "tr": "ve bir bu da de için ile olarak daha çok ama gibi sonra kadar olan değil en her ne",
}
# What languages are called, by language.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés ingles", "de": "german deutsch allemand alemán aleman", "fr": "french französisch français francés frances",
    "es": "spanish spanisch espagnol español castilian", "it": "italian italienisch italien italiano", "pt": "portuguese portugiesisch portugais portugués",
    "nl": "dutch niederländisch néerlandais neerlandés", "pl": "polish polnisch polonais polaco", "sv": "swedish schwedisch suédois sueco",
    "tr": "turkish türkisch turc turco", "zh": "chinese chinesisch chinois chino mandarin", "ja": "japanese japanisch japonais japonés",
    "ko": "korean koreanisch coréen coreano", "ru": "russian russisch russe ruso", "ar": "arabic arabisch arabe árabe", "el": "greek griechisch grec griego",
    "he": "hebrew hebräisch hébreu hebreo", "hi": "hindi", "th": "thai",
}
# Ranges of scripts that tell a language, and stand-ins for "no value".
SCRIPTS = (
    ("ja", r"[぀-ヿ]"), ("ko", r"[가-힯ᄀ-ᇿ]"), ("zh", r"[㐀-鿿]"), ("ru", r"[Ѐ-ӿ]"), ("ar", r"[؀-ۿ]"),
    ("el", r"[Ͱ-Ͽ]"), ("he", r"[֐-׿]"), ("hi", r"[ऀ-ॿ]"), ("th", r"[฀-๿]"),
)
STAND_INS = frozenset(
    x.strip()
    for x in """null|none|nan|n/a|na|n a|nil|undefined|empty|blank|tbd|tba|todo|missing|void|no answer|no answer given|no response|no value|no output|
    no data|no text|no content|no result|not available|not applicable|not given|not provided|not answered|unanswered|answer missing|missing answer|
    answer pending|to be done|to be determined|to be added|empty string|empty response|empty answer|k. a.|k.a.|keine antwort|keine angabe|leer|
    sin respuesta|ninguna respuesta|vacío|sans réponse|aucune réponse|vide""".split("|")
)

_STAND_INS = sorted(STAND_INS)

_LANG_WORDS: dict[str, list[tuple[str, float]]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _LANG_WORDS.setdefault(_w, []).append((_lang, 0.0))
_LANG_WORDS = {w: [(lang, 1.0 / len(v)) for lang, _ in v] for w, v in _LANG_WORDS.items()}
_NAME_OF = {n: lang for lang, names in LANGUAGE_NAMES.items() for n in names.split()}
_SCRIPT_RE = [(lang, re.compile(p)) for lang, p in SCRIPTS]

_WORD = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)?")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)?|```|[^\w\s]|_+|\n")
_INVISIBLE = re.compile(r"[­͏؜ᅟᅠ឴឵᠎​-‏ -‮⁠-⁯⠀ㅤ︀-️﻿ﾠ]")
_REPEAT = re.compile(
    r"\b(?:repeat|word for word|verbatim|echo|copy (?:this|the)|say exactly|write exactly|quote|recite|restate|reproduce this|wiederhol\w*|wörtlich|wortwörtlich|répét\w*|répèt\w*|mot pour mot|recopie\w*|repit\w*|repet\w*|palabra por palabra|copia)\b", re.I
)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=。)|\n+")
_END = {".": ".", "!": "!", "?": "!", "。": ".", "！": "!", "？": "!", "．": ".", "…": "…", ",": ",", ";": ",", ":": ":", "-": "-", "–": "-", "—": "-", "(": "(", "[": "(", "{": "("}
_CLOSERS = "\"'”’»)]}*_`"


def language(text: str) -> str:
    """The language that script or function words tell, or ''."""
    if not text.isascii():
        letters = sum(map(str.isalpha, text))
        for lang, pattern in _SCRIPT_RE:
            n = len(pattern.findall(text))
            if n >= 2 and n >= 0.2 * letters:
                return lang
    words = _WORD.findall(text.lower())
    if len(words) < 3:
        return ""
    scores: dict[str, float] = {}
    for w in words:
        for part in {w, *re.split(r"['’]", w)} if "'" in w or "’" in w else (w,):
            for lang, x in _LANG_WORDS.get(part, ()):
                scores[lang] = scores.get(lang, 0.0) + x
    if "¿" in text or "¡" in text:
        scores["es"] = scores.get("es", 0.0) + 2
    if "ß" in text:
        scores["de"] = scores.get("de", 0.0) + 1
    ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    if not ranked or ranked[0][1] < 0.9 or len(ranked) > 1 and ranked[0][1] < 1.3 * ranked[1][1]:
        return ""
    return ranked[0][0]


def content(text: str) -> str:
    """What is left without markup, entities, invisible characters, punctuation and blanks."""
    plain = html.unescape(text) if "&" in text else text
    plain = _INVISIBLE.sub("", re.sub(r"</?[A-Za-z!][^<>]*>", " ", plain))
    return " ".join(_WORD.findall(plain))


def plain_words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(_INVISIBLE.sub("", text))]


class Vocabulary:
    """Words of the sample's responses; all others are known by their shape only."""

    def __init__(self, texts: list[str]):
        n = Counter(w for t in texts for w in set(_WORD.findall(t)))
        self.words = frozenset(w for w, k in n.items() if k >= 2 and not (w[0].isupper() and k < 0.002 * len(texts)))

    def token(self, t: str) -> str:
        c = t[0]
        if c.isdigit():
            return "0"
        if not (c.isalpha() or c == "_"):
            return t[0] if t != "```" else t
        if t in self.words or t.lower() in self.words:
            return t.lower()
        return "Xx" if c.isupper() else "xx" if c.isascii() or c.islower() else "cjk"


def features(q: str | None, a: str, vocabulary: Vocabulary) -> list[str]:
    """Names of the pair's binary features; names are hashed by the classifier."""
    f = ["bias"]
    text = _INVISIBLE.sub("", a).strip()
    bare = content(a)
    words = plain_words(text)
    kept = bare.lower()
    if not kept:
        f.append("no words")
        return f
    if kept.count(" ") < 5:  # a short response is known as a whole
        f.append(f"whole:{kept}")
    tokens = [vocabulary.token(t) for t in _TOKEN.findall(text)]
    tail = text.rstrip()
    while tail and tail[-1] in _CLOSERS and len(tail) > 1:
        tail = tail[:-1].rstrip()
    end = _END.get(tail[-1:], "w" if tail[-1:].isalnum() else "x") if tail else "x"
    if text.endswith("```"):
        end = "fence"
    opened = text.count("```") % 2 == 1
    body = re.sub(r"```.*?(?:```|\Z)", " ", text, flags=re.S)
    quotes = body.count('"') % 2 == 1 or body.count("“") > body.count("”") or body.count("«") > body.count("»") or body.count("„") > body.count("“") + body.count("”")
    brackets = any(body.count(x) > body.count(y) for x, y in ("()", "[]", "{}"))
    lines = [line for line in text.split("\n") if line.strip()]
    item = re.match(r"\s*(?:[-*•]|\d+[.)])\s*", lines[-1]) if lines else None
    listed = len(lines) > 1 and item is not None
    sentences = min(3, len(re.findall(r"[.!?。](?:\s|$)", body)))
    n = len(words)
    size = "1" if n == 1 else "2-4" if n < 5 else "5-9" if n < 10 else "10+"
    f += [f"end={end}", f"size={size}", f"end={end},s={sentences},{size}", f"list={listed}", f"end={end},list={listed}"]
    f += ["open fence"] * opened + ["open quote"] * quotes + ["open bracket"] * brackets
    if n == 1:  # a single word is an answer of its own, whatever it would be in a sentence
        f.append(f"single,{end}")
    elif end not in (".", "!", "fence"):
        f += ["unended"] + [f"un{k}:" + " ".join(tokens[-k:]) for k in (1, 2, 3, 4) if len(tokens) >= k]
        f += [f"un,s={sentences},list={listed}", f"un1s:{tokens[-1]},{min(1, sentences)},{listed}"]
        if not listed:
            f.append(f"un,first={' '.join(tokens[:2])},s={min(1, sentences)}")
    if listed:
        rest = len(_WORD.findall(lines[-1][item.end() :]))
        f.append(f"item={min(rest, 2)}")
        if rest == 0:
            f.append("bare item")
    head = tokens[:HEAD] if n > 1 else []
    f += [f"h{k}:" + " ".join(head[:k]) for k in (1, 2, 3, 4) if head]
    # Every token is seen: those of the head, of the last sentence, and what lies between, where n-grams reach into the head.
    last = [vocabulary.token(t) for t in _TOKEN.findall(_SENTENCE.split(text)[-1])] if len(tokens) > HEAD else []
    # What a head tells of a cut, a copy or a language the rest does not: beyond it, n-grams speak about refusals alone.
    for mark, part in (("", head), (MARK + "m", tokens[HEAD - 2 : len(tokens) - len(last)] if len(tokens) - len(last) > HEAD else []), (MARK + "l", last)):
        f += [mark + "u:" + t for t in set(part)] + [mark + "b:" + " ".join(p) for p in set(zip(part, part[1:], strict=False))]
        f += [mark + "t:" + " ".join(p) for p in set(zip(part, part[1:], part[2:], strict=False))]
    asked = plain_words(q) if q else []
    if asked:
        joined, needle = " ".join(words), " ".join(asked)
        repeat = bool(_REPEAT.search(q))
        times = joined.count(needle) if needle else 0
        left = len(joined.replace(needle, " ").split()) if times else n
        if times:
            f += [f"holds question,left={'0' if not left else '1-2' if left < 3 else '3+'}", f"holds,left={min(left, 3)},repeat={repeat}"]
        elif n >= 2 and asked[-n:] == words:
            f.append(f"end of question,repeat={repeat},{size}")
        elif n >= 3:
            shared = sum(w in set(asked) for w in words) / n
            f.append(f"shared={int(shared * 5)},repeat={repeat}")
            if shared == 1 and len(set(words)) >= 0.8 * len(set(asked)):
                f.append(f"same words,repeat={repeat}")
    if q:
        lq, la = language(q), language(text)
        if la and lq:
            named = {_NAME_OF[w] for w in asked if w in _NAME_OF}
            f.append(f"language same={la == lq},asked={la in named}")
            if la != lq and la not in named:
                f.append("other language")
    return f


class Classifier(LinearModel):
    """One score per defect, with calibrated thresholds."""

    def __init__(self):
        super().__init__(len(DEFECTS), DEFECTS.index("refusal"))
        self.thresholds = np.full(len(DEFECTS), 0.5)

    def calibrate(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        """Per defect a threshold of nearly the greatest F1 at PREVALENCE. Of those within TOLERANCE of it the middle one is taken."""
        p = self.scores(rows)
        for k in range(len(DEFECTS)):
            positive, negative = np.sort(p[y[:, k] == 1, k]), np.sort(p[~y.any(axis=1), k])
            if not len(positive) or not len(negative):
                continue
            cuts = np.linspace(0.02, 0.98, 97)
            recall = 1 - np.searchsorted(positive, cuts) / len(positive)
            false = 1 - np.searchsorted(negative, cuts) / len(negative)
            precision = recall * PREVALENCE / np.maximum(recall * PREVALENCE + false * (1 - PREVALENCE), 1e-9)
            f1 = 2 * precision * recall / np.maximum(precision + recall, 1e-9)
            best = cuts[f1 >= f1.max() - TOLERANCE]
            self.thresholds[k] = best[len(best) // 2]

    def labels(self, rows: list[np.ndarray]) -> list[list[tuple[str, float]]]:
        """Of each row the defects whose scores reach their thresholds, with the odds beyond, the greatest first."""
        p = np.clip(self.scores(rows), 1e-6, 1 - 1e-6)
        margin = np.log(p / (1 - p)) - np.log(self.thresholds / (1 - self.thresholds))
        return [sorted(((DEFECTS[k], float(m[k])) for k in np.flatnonzero(m > 0)), key=lambda x: -x[1]) for m in margin]

    def decide(self, rows: list[np.ndarray]) -> list[str | None]:
        """The first of the labels; None if there is none."""
        return [x[0][0] if x else None for x in self.labels(rows)]


#: Sound pairs that every sample has besides its own, so that a fit is never without one.
EXAMPLES = (
    ("What colour is the door?", "The door is green."), ("How many rooms does the house have?", "It has four rooms and a kitchen."), ("Who wrote the letter?", "Her brother wrote it in May."),
    ("When does the train leave?", "The train leaves at noon."), ("Where is the key?", "The key lies under the mat."), ("Name three fruits.", "Apples, pears and plums"),
)

#: Features that no pair is taken as sound with.
UNCLOSED = frozenset(("open fence", "open bracket", "open quote", "bare item"))

# Phrases of refusals to train on, by language: openings, and what is refused.
_REFUSALS = {
    "en": (
        ("I'm sorry, but I can't {v} {o}.", "I am sorry, but I cannot {v} {o}.", "Sorry, I can't {v} {o}.", "I cannot {v} {o}.", "I can't {v} {o}.", "As an AI model I am not able to {v} {o}.", "As an AI language model, I cannot {v} {o}.",
         "Unfortunately, I must decline to {v} {o}.", "I must decline to {v} {o}.", "I won't be able to {v} {o}.", "I'm unable to {v} {o}.", "I am not able to {v} {o}.", "Regrettably I don't have the ability to {v} {o}, and I don't want to guess.",
         "Apologies, this request falls outside what I may discuss.", "Apologies, I cannot {v} {o}.", "I have to pass on this one, since I'm only a language model.", "I'd rather not {v} {o}.", "It would not be appropriate for me to {v} {o}.",
         "My guidelines do not allow me to {v} {o}.", "I'm afraid I can't {v} {o}.", "I do not feel comfortable with {o}, so I will not answer.", "This is something I'm not permitted to {v}.", "I refuse to {v} {o}.", "That is beyond what I am allowed to {v}.",
         "It would not be appropriate for me to {v} {o}, so I will leave it there.", "That is not something I'm comfortable answering.", "My guidelines don't allow me to {v} {o}.",
         "I won't be able to {v} {o}; please speak to a professional.", "No, I would rather not get into {o}.", "No, I will not {v} {o}."),
        ("help with", "assist with", "answer questions about", "discuss", "comment on", "share information about", "provide details on", "talk about", "answer", "respond to"),
        ("that", "this", "this topic", "this request", "that kind of report", "requests about {n}", "the query of {n}", "{n}", "that request", "this question", "the {k} of {n}", "that kind of {k}", "requests about the {k} of {n}"),
    ),
    "de": (
        ("Es tut mir leid, aber dabei kann ich nicht helfen.", "Leider kann ich {o} nicht {v}.", "Als Sprachmodell kann ich {o} nicht {v}.", "Leider darf ich zu {n} keine Auskunft geben.", "Ich kann {o} nicht {v}.", "Entschuldigung, dazu darf ich nichts sagen.", "Dabei kann ich leider nicht helfen.", "Dazu möchte ich nichts sagen.", "Ich möchte {o} lieber nicht {v}."),
        ("beantworten", "besprechen", "bearbeiten", "kommentieren"), ("diese Frage", "diese Anfrage", "das"),
    ),
    "fr": (
        ("Je suis désolé, mais je ne peux pas {v}.", "En tant que modèle de langage, je ne peux pas {v}.", "Désolé, je ne peux pas {v}.", "Malheureusement, je ne suis pas en mesure de {v}.", "Je regrette, mais je ne suis pas autorisé à {v}.", "Je ne peux pas donner d'informations sur {n}.", "Malheureusement, je n'ai pas le droit de parler de {n}.", "Je préfère ne pas {v}."),
        ("vous aider", "répondre à cette question", "aider avec cette demande", "parler de {n}"), ("cela",),
    ),
    "es": (
        ("Lo siento, pero no puedo {v}.", "Prefiero no contestar a eso.", "Prefiero no {v}.", "Como modelo de lenguaje no puedo {v}.", "Lamentablemente no puedo {v}.", "Lo lamento, no me es posible {v}.", "No estoy autorizado a {v}.", "Por desgracia no puedo dar información sobre {n}."),
        ("ayudar con eso", "responder a esta pregunta", "ayudarle", "hablar de {n}"), ("eso",),
    ),
}
_AFTER = {
    "en": ("", "", " Is there anything else you would like to talk about?", " Please rephrase the request.", " Thank you for understanding.", " Feel free to ask me something else.", " I can talk about general topics instead."),
    "de": ("", " Kann ich sonst etwas für Sie tun?"), "fr": ("", " Puis-je vous aider pour autre chose ?"), "es": ("", " ¿Puedo ayudarle en otra cosa?"),
}
# What may stand before a refusal as well as before an answer, and apologies of answers.
_PREAMBLES = {
    "en": ("Thank you for your question about the {k} of {n}.", "Thanks for asking about {n}, I have read your message with care.", "You asked me about the {k} of {n} and what became of it.", "I see that you would like to know more about the {k} of {n}.",
           "I have looked at the {k} and at what you wrote about it.", "This is a good question about {n}, and I understand why you ask it.", "I appreciate that you took the time to describe the {k} of {n} to me.", "Hello and thank you for your patience."),
    "de": ("Vielen Dank für Ihre Frage zu {n}.", "Danke für die Nachricht, ich habe sie genau gelesen.", "Sie fragen nach {n} und was daraus geworden ist.", "Ich verstehe, dass Sie mehr über {n} wissen möchten."),
    "fr": ("Merci pour votre question sur {n}.", "Merci pour votre message, je l'ai lu avec attention.", "Vous me demandez ce qui est arrivé à {n}.", "Je comprends que vous vouliez en savoir plus sur {n}."),
    "es": ("Gracias por su pregunta sobre {n}.", "Gracias por su mensaje, lo he leído con atención.", "Usted pregunta por {n} y por lo que pasó con ello.", "Entiendo que quiera saber más sobre {n}."),
}
_APOLOGIES = {
    "en": ("I'm sorry for the delay.", "Sorry about the earlier mix-up.", "I apologize for the confusion.", "Apologies for the wait, here is what I found.", "I am sorry that the last reply was wrong.", "I'm sorry to hear that."),
    "de": ("Entschuldigung für die Verzögerung.", "Es tut mir leid, dass es so lange gedauert hat."),
    "fr": ("Désolé pour le retard.", "Je suis désolé pour cette confusion."), "es": ("Lo siento por la demora.", "Lamento la confusión."),
}
_EMPTIES = ("", " ", "\n", "\t \n", "  ", "​", "-", "--", ".", "...", "…", "n/a", "N/A", "null", "None", "(empty)", "[]", "{}", '""', "''", "<br/>", "<p></p>", "&nbsp;", "```\n```", "TBD", "no answer given", "---", "?", "[none]", "<empty>", "* * *")


def _refusal(rng: random.Random, lang: str, name: str, kind: str) -> str:
    forms, verbs, objects = _REFUSALS.get(lang, _REFUSALS["en"])
    text = rng.choice(forms).replace("{v}", rng.choice(verbs)).replace("{o}", rng.choice(objects)).replace("{n}", name).replace("{k}", kind)
    return (text + rng.choice(_AFTER.get(lang, ("",)))).replace("'", rng.choice("'''’"))


def _brief(rng: random.Random) -> str:
    """A sound answer of a word or two: a number, a letter, yes or no, an invented name."""
    name = "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))).capitalize()
    number = str(rng.randint(0, 10 ** rng.randint(1, 5)))
    text = rng.choice((number, name, f"{name} {name.lower()}", f"{number} {name.lower()}", rng.choice("ABCDE"), rng.choice(("Yes", "No", "Ja", "Nein", "Oui", "Non", "Sí", "True", "False"))))
    return text + rng.choice(("", "", "", "."))


def _emptied(rng: random.Random, text: str | None = None) -> str:
    """Nothing, marks only, or a stand-in (that given, else any) in some writing."""
    if text is None and rng.random() < 0.3:
        return rng.choice(_EMPTIES)
    text = text or rng.choice(_STAND_INS)
    text = rng.choice((text, text, text.upper(), text.capitalize(), text.title()))
    return rng.choice(("{}", "{}", "{}", "{}.", "[{}]", "({})", "<{}>", '"{}"', "<p>{}</p>", "**{}**", " {} ", "- {}")).replace("{}", text)


def _before(rng: random.Random, lang: str, name: str, kind: str, sentences: list[str]) -> str:
    """One or two sentences that neither answer nor refuse: preambles, or sound sentences of other pairs."""
    forms = _PREAMBLES.get(lang, _PREAMBLES["en"])
    chosen = [rng.choice(sentences) if sentences and rng.random() < 0.4 else rng.choice(forms).replace("{n}", name).replace("{k}", kind) for _ in range(rng.choice((1, 1, 2)))]
    return " ".join(chosen) + " "


def _truncated(rng: random.Random, a: str) -> str | None:
    text = a.strip()
    kind = rng.random()
    if kind < 0.06:
        return text + rng.choice((" (", " [")) + " ".join(text.split()[: rng.randint(2, 5)]).lower()
    if kind < 0.12:
        return text + rng.choice((' "', " The note ends with \"", " “")) + " ".join(text.split()[: rng.randint(2, 5)]).lower()
    if kind < 0.18:
        name = "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
        code = f"```python\ndef score_{name}(rows):\n    total = 0\n    for row in rows:\n        total += row.value\n    return total"
        return text + "\n" + code[: rng.randint(14, len(code))].rstrip()
    if kind < 0.24:
        items = [" ".join(text.split()[i : i + 3]).strip(".,") for i in range(0, 9, 3)]
        marks = rng.choice((("- ", "- ", "- ", "- "), ("1. ", "2. ", "3. ", "4. ")))
        return text + "\n" + "\n".join(m + i for m, i in zip(marks, items[: rng.randint(1, 3)], strict=False)) + "\n" + rng.choice((marks[3].strip(), marks[3] + items[0][:2]))
    if len(text) < 24:
        return None
    if kind < 0.7:  # within the last sentence
        last = max((m.end() for m in re.finditer(r"[.!?]\s+", text[:-2])), default=0)
        low = last + 4
    else:
        low = len(text) // 3
    if low >= len(text) - 3:
        return None
    cut = text[: rng.randint(low, len(text) - 3)].rstrip()
    if rng.random() < 0.4:
        cut = cut.rsplit(None, 1)[0]
    if cut and rng.random() < 0.08 and cut[-1].isalnum():
        return cut + rng.choice(("…", "...", " …"))
    if not cut or cut[-1] in ".!?。" or text[len(cut) :].strip() in (".", "!", "?", ""):
        return None
    return cut


def _copied(rng: random.Random, q: str) -> str:
    forms = (q, q, q.upper(), q.lower(), f'"{q.rstrip(" .?!")}"', f"{q} {q}", q.rstrip(" .?!"), q.rstrip(" .?!") + rng.choice(("!", "...", ".", "")), "  ".join(q.split()), "  " + q.rstrip(".?!"), f"> {q}", f"**{q}**", f"Question: {q}", f"Q: {q}", f"Task: {q}", f"You asked: {q}", f"The question was: {q}", f"{q}\n{q}")
    return rng.choice(forms)


def context_of(pairs: list[tuple[str | None, str]]) -> tuple:
    """What made pairs take from the whole sample: names, subjects, responses by language, whole sentences by language."""
    names = [w for q, _ in pairs if q for w in re.findall(r"(?<=\w )[A-Z][a-z]{3,}", q)] or ["Alpha"]
    # What a refusal is about: a word or two of some prompt.
    kinds = [m for q, _ in pairs if q for m in re.findall(r"\b[a-z]{4,}(?: [a-z]{3,})?\b", q)] or ["report"]
    by_language: dict[str, list[str]] = {}
    for _, a in pairs:
        by_language.setdefault(language(a), []).append(a)
    whole = {k: [x.strip() for a in v for x in re.findall(r"[^.!?\n]{20,}[.!?](?=\s|\Z)", a)] for k, v in by_language.items()}
    return names, kinds, by_language, whole


def synthesize(pairs: list[tuple[str | None, str]], seed: int, context: tuple | None = None, inside: range | None = None) -> list[tuple[int, str | None, str, int | None]]:
    """(place of the pair, prompt, response, defect number) made from the sample's pairs. None: sound, a response without its full stop.

    What is made of a pair depends on its place and the seed alone, so that parts of the sample can be made apart.
    """
    names, kinds, by_language, whole = context_of(pairs) if context is None else context
    known = sorted(k for k in by_language if k)
    made: list[tuple[int, str | None, str, int | None]] = []
    for place in range(len(pairs)) if inside is None else inside:
        q, a = pairs[place % len(pairs)]
        rng = random.Random(seed * 1_000_003 + place)
        out: list[tuple[str | None, str, int | None]] = []
        if rng.random() < TRUNCATED_SHARE and (t := _truncated(rng, a)) is not None:
            out.append((q, t, DEFECTS.index("truncated")))
        if a.rstrip().endswith(".") and rng.random() < 0.6:
            ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", a)]
            part = a[: ends[0]] if ends and rng.random() < 0.7 else a  # the first sentence, or all
            out.append((q, part.rstrip()[:-1], None))
        if rng.random() < 0.1 and a.rstrip().endswith("."):
            # Unknown words are no evidence of a defect.
            out.append((q, re.sub(r"[a-z]{3,}", lambda m: "".join(rng.choice("bcdfghklmnprstvwaeiou") for _ in m.group()), a), None))
        lang = language(q) if q else "en"
        if rng.random() < 0.35:
            out.append((q, _refusal(rng, lang or "en", rng.choice(names), rng.choice(kinds)), DEFECTS.index("refusal")))
        spoken = lang or language(a) or "en"
        told = (spoken, rng.choice(names), rng.choice(kinds))
        if rng.random() < 0.15:
            out.append((q, _before(rng, *told, whole.get(spoken, [])) + _refusal(rng, *told), DEFECTS.index("refusal")))
        if language(a) == spoken and rng.random() < 0.25:
            # What an answer follows, or an apology beside one, is no refusal.
            sorry = rng.choice(_APOLOGIES.get(spoken, _APOLOGIES["en"]))
            out.append((q, rng.choice((_before(rng, *told, []) + a, f"{sorry} {a}", f"{_before(rng, *told, [])}{sorry} {a}", f"{a.rstrip()} {sorry}")), None))
        if rng.random() < 0.12:
            out.append((q, _emptied(rng), DEFECTS.index("empty")))
        if place < STAND_IN_TIMES * len(_STAND_INS):  # whatever the sample, every stand-in is among the made ones
            out.append((q, _emptied(random.Random(place), _STAND_INS[place % len(_STAND_INS)]), DEFECTS.index("empty")))
        if rng.random() < 0.4:
            out.append((q, _brief(rng), None))
        if q and content(q) and len(q.split()) > 1 and not _REPEAT.search(q) and rng.random() < 0.35:
            out.append((q, _copied(rng, q), DEFECTS.index("copy")))
        others = [k for k in known if k != lang]
        if q and lang and others and rng.random() < 0.35:
            other = rng.choice(others)
            if not any(_NAME_OF.get(w) == other for w in plain_words(q)):
                out.append((q, rng.choice(by_language[other]), DEFECTS.index("language")))
        made += [(place, *x) for x in out]
    return made


def _labels(defects: list[int | None]) -> np.ndarray:
    y = np.zeros((len(defects), len(DEFECTS)), dtype=np.float32)
    for i, k in enumerate(defects):
        if k is not None:
            y[i, k] = 1
    return y


def _tasks(spark: SparkSession | None, n: int, f: Callable[[int], object]) -> list:
    """[f(0), .., f(n - 1)], each in a task of its own if there is a session."""
    if spark is None:
        return [f(i) for i in range(n)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"]:
                yield pd.DataFrame({"id": [i], "out": [pickle.dumps(f(int(i)))]})

    rows = spark.range(0, n, 1, n).mapInPandas(run, "id long, out binary").collect()  # n bounded results
    return [pickle.loads(r["out"]) for r in sorted(rows, key=lambda r: r["id"])]


class _Rows:
    """Feature rows of a list of pairs, one after the other."""

    def __init__(self, rows: list[np.ndarray]):
        self.flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
        self.ends = np.cumsum([len(r) for r in rows]) if rows else np.zeros(0, np.int64)

    def rows(self) -> list[np.ndarray]:
        return [r.astype(np.int64) for r in np.split(self.flat, self.ends[:-1])] if len(self.ends) else []


def fit(pairs: list[tuple[str | None, str]], seed: int = SEED, spark: SparkSession | None = None) -> tuple[Vocabulary, Classifier]:
    """Fit on the sample, without the pairs of it that look defective themselves, and calibrate on a fifth held out.

    What looks defective is told by models that have not seen the pair: the sample is cut into FOLDS, each is
    judged by a model of the others, and pairs with a score above SUSPECT are left out of the fit. Features and
    models are made in tasks; the sample, its features and the models are of bounded size.
    """
    pairs = sorted({*pairs, *EXAMPLES}, key=lambda p: (p[0] or "", p[1]))
    n = len(pairs)
    vocabulary, context = Vocabulary([a for _, a in pairs]), context_of(pairs)
    share = spark.sparkContext.broadcast if spark else lambda x: SimpleNamespace(value=x)
    places = n * -(-MADE_OF // n) if n < MADE_OF else n
    given = share((pairs, vocabulary, context))

    def part(i: int) -> tuple:
        pairs, vocabulary, context = given.value
        named = [features(*pairs[k], vocabulary) for k in range(n * i // TASKS, n * (i + 1) // TASKS)]
        made = synthesize(pairs, seed, context, range(places * i // TASKS, places * (i + 1) // TASKS))
        closed = [not any(x in UNCLOSED for x in f) for f in named]
        return _Rows([indices(f) for f in named]), closed, [(m[0] % n, m[3]) for m in made], _Rows([indices(features(q, a, vocabulary)) for _, q, a, _ in made])

    parts = _tasks(spark, TASKS, part)
    closed = np.array([x for p in parts for x in p[1]], dtype=bool)
    source = np.array([k for p in parts for k, _ in p[2]], dtype=np.int64)
    labels = _labels([None] * n + [d for p in parts for _, d in p[2]])
    data = share(([r for p in parts for r in p[0].rows()] + [r for p in parts for r in p[3].rows()], labels, source))

    def train(inside: np.ndarray, use: np.ndarray, seed: int, whole: bool, share_of_made: float = 1.0) -> Classifier:
        rows, y, source = data.value
        usable = inside & (use.min(axis=1) > 0)
        made = np.flatnonzero(usable[source] & (np.random.default_rng(seed).random(len(source)) < share_of_made))
        at = np.concatenate([np.flatnonzero(inside), n + made])
        w = np.concatenate([use[inside], np.ones((len(made), len(DEFECTS)), dtype=np.float32)])
        chosen = [rows[i] for i in at]
        model = Classifier()
        model.fit(chosen if whole else [r[r < 1 << BITS] for r in chosen], y[at], w, seed)
        return model

    fold = np.random.default_rng(seed).permutation(n) % FOLDS
    suspect = np.array([SUSPECT[d] for d in DEFECTS])
    example = np.array([p in EXAMPLES for p in pairs])
    use = np.ones((n, len(DEFECTS)), dtype=np.float32)
    use[~closed, DEFECTS.index("truncated")] = 0
    # What stands beside refusals of the sample would pass as sound: those that the head tells are left out before the rest is fitted on.
    for step in range(ROUNDS + 1):
        whole, current = step == ROUNDS, use

        def judge(k: int, whole=whole, step=step, current=current) -> tuple:
            out = np.flatnonzero(fold == k)
            return out, train(fold != k, current, seed + 10 * step + k, whole).scores([data.value[0][i] for i in out])

        scores = np.zeros((n, len(DEFECTS)))
        for out, x in _tasks(spark, FOLDS, judge):
            scores[out] = x
        use = use * (scores < suspect) if whole else (scores < suspect).astype(np.float32)
        use[~closed, DEFECTS.index("truncated")] = 0
        use[example] = 1
    held = (np.random.default_rng(seed).random(n) < 0.2) & ~example

    def bagged(j: int) -> tuple:
        w = train(~held, use, seed + 99 + j, True, BAG_SHARE).w
        at = np.flatnonzero(w.any(axis=1))
        return at, w[at]

    model = Classifier()
    for at, w in _tasks(spark, BAG, bagged):
        model.w[at] += w / BAG
    # As sound ones only real pairs count here: how often a made one looks defective says nothing about the data.
    rows, y, source = data.value
    sound = held & (use.min(axis=1) > 0)
    at = np.concatenate([np.flatnonzero(sound), n + np.flatnonzero(sound[source] & y[n:].any(axis=1))])
    model.calibrate([rows[i] for i in at], y[at])
    return vocabulary, model


def _sample(pairs: DataFrame) -> list[tuple[str | None, str]]:
    """At most SAMPLE_PAIRS distinct pairs, chosen by hash. Of longer texts the whole sentences within SAMPLE_CHARS are taken."""
    within = lambda c, n: F.when(F.length(c) <= n, F.col(c)).otherwise(F.regexp_substr(F.substring(c, 1, n), F.lit(r"(?s)\A.*[.!?](?=\s)")))
    usable = pairs.select(within("q", SAMPLE_CHARS // 2).alias("q"), within("a", SAMPLE_CHARS // 2).alias("a")).where("length(a) > 0")
    key = F.xxhash64("q", "a")
    # So many distinct pairs there are about: repeated ones do not thin the sample.
    total = usable.agg(F.approx_count_distinct(key, 0.05)).first()[0]
    chosen = usable.where(F.pmod(key, F.lit(max(1, total // (3 * SAMPLE_PAIRS)))) == 0).distinct()
    return [(r["q"], r["a"]) for r in chosen.orderBy(F.xxhash64("a", "q")).limit(SAMPLE_PAIRS).collect()]


def label_pairs(pairs: DataFrame) -> DataFrame:
    """(table_name, record_id, labels) of the rows of pairs (table_name, record_id, q, a): every defect whose score
    reaches its threshold, as an array of (defect, margin), the greatest margin first; an empty array for sound rows.

    A null response counts as an empty one. A null prompt can neither be copied nor differ in language. Every copy
    of a repeated row counts. The sample is bounded by SAMPLE_PAIRS; all rows are judged. An empty table gives an
    empty table. Texts of any length are judged whole: n-grams are those of all tokens.
    """
    spark = pairs.sparkSession
    shared = spark.sparkContext.broadcast(fit(_sample(pairs), spark=spark))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, model = shared.value
        for batch in batches:
            rows = [indices(features(q if isinstance(q, str) else None, a if isinstance(a, str) else "", vocabulary)) for q, a in zip(batch["q"], batch["a"], strict=True)]
            yield batch[["table_name", "record_id"]].assign(labels=model.labels(rows))

    schema = "table_name string, record_id bigint, labels array<struct<defect: string, margin: double>>"
    return pairs.select("table_name", "record_id", "q", "a").mapInPandas(judge, schema)


def find_defects(pairs: DataFrame) -> DataFrame:
    """(table_name, record_id, defect) of the defective rows of pairs: of the labels of label_pairs the first, as one defect applies."""
    return label_pairs(pairs).where("size(labels) > 0").select("table_name", "record_id", F.get("labels", 0)["defect"].alias("defect"))


def pairs_of(df: DataFrame, table_name: str, id_col: str, question_col: str, answer_col: str) -> DataFrame:
    return df.select(
        F.lit(table_name).alias("table_name"), F.col(f"`{id_col}`").cast("bigint").alias("record_id"),
        F.col(f"`{question_col}`").cast("string").alias("q"), F.col(f"`{answer_col}`").cast("string").alias("a"),
    )
