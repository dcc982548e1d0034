"""Documents with template residue, filler, error pages or script notices where content belongs.

Documents are cut into passages, equal passages (case, digits and spacing aside) are one. A trusted seed is
labelled by form: slots, dummy text, status lines, error objects, and well-known notices. What a seed
passage says without its status head or interjection is its core; the cores are the nodes. Nodes that are
near-duplicates are found through partitioned SimHash tables, verified by Hamming distance and by the
similarity of their shingles, and the residue label spreads along verified links through the connected
components, to their end. A document with a passage of a residue component comes out.

Slots, dummy Latin, repeated words, status lines and error objects are told in any language. The well-known
notices that seed the search are English, German, French, Spanish, Italian, Portuguese, Dutch and Polish;
fixed phrases of filler and scripts are English, German, French and Spanish.
"""

from __future__ import annotations

import html
import itertools
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.session import cut, small_side

SHINGLE, SIMILARITY, HAMMING = 5, 0.8, 3
#: Cores of fewer words say too little to link passages that differ.
CORE_WORDS = 4
#: A passage counts as filler from so many words on, if this share of them is filler.
FILLER_WORDS, FILLER_SHARE = 4, 0.7

# Words of the customary dummy Latin, keyboard filler, names of HTML elements.
LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna
    aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute
    irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non
    proident sunt culpa qui officia deserunt mollit anim id est laborum""".split()
)
KEYS = frozenset("asdf asdfasdf qwerty qwertz hjkl jkl foo bar baz blah bla xxx xxxx zzz test testing".split())
TAGS = frozenset(
    """a abbr address article aside audio b base bdi bdo blockquote body br button canvas caption center cite code col
    colgroup data datalist dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form h h1
    h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark menu meta
    meter nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script search
    section select slot small source span strong style sub summary sup svg table tbody td template textarea tfoot th
    thead time title tr track tt u ul var video wbr""".split()
)
# Reason phrases of HTTP status codes.
REASONS = (
    "bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|request timeout|conflict|gone|"
    "too many requests|unavailable for legal reasons|internal server error|server error|not implemented|bad gateway|"
    "service unavailable|gateway time-?out|proxy authentication required"
)

#: Blanks other than the plain one and line ends.
_BLANKS = r"[\t\x0b\f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_FENCE = r"(?s)```.*?(?:```|\z)"
#: Words that stand in brackets and capitals without being slots: levels, outcomes, marks of models and editors.
_LEVELS = "INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL|CRITICAL|NOTICE|DONE|FAIL|FAILED|PASS|PASSED|SKIP|SKIPPED|CLS|SEP|MASK|PAD|UNK|INST|EOS|BOS|SIC|NULL|EDIT|PDF|VIDEO"
_DOLLARS = re.compile(r"(?<![\w$\\])\$[a-z]{2,20}(?:_[a-z]{2,20})*\$(?!\w)")
_CODE = re.compile(r"`[^`]*`|\$[^$\s](?:[^$]*[\\^_{=+][^$]*)?\$(?!\w)|\\\w+\{[^}]*\}|[_^]\{[^}]*\}")
_NAME = r"[^\W\d][\w.]*(?: [\w.]+){0,3}"
_SLOTS = re.compile(
    "|".join(
        (
            r"\{\{\{?\s*[^{}]{1,60}\}?\}\}", r"\{%[^%{}]{1,80}%\}", r"<%=?[^%<>]{1,60}%>", rf"\$\{{\s*{_NAME}\s*\}}",
            rf"(?<![\w$\\^_]){{\s*{_NAME}\s*}}", r"<<\s*\w[\w ]{0,40}>>", r"%\(\w{1,40}\)[sd]", r"##\s?[a-z][\w ]{1,40}##", r"@@\s?[a-z][\w ]{1,40}@@",
            r"(?<![\w.])__[a-z][a-z_]{1,40}[a-z]__(?![\w(.])", r"\[\[\s*[a-z][\w ]{1,40}\]\]", r"_{5,}", r"\.{8,}",
        )
    )
)
_ANGLE = re.compile(r"<([a-z][a-z0-9_-]{2,40})>")
_SPACED_ANGLE = re.compile(r"<([a-z]{2,20})(?: [a-z]{2,20}){1,3}>")
_HINT = (
    r"your \w+|insert|placeholder|fill in|to be (?:filled|added|completed|defined|done)|goes here|name of|enter |replace|tbd|tba|todo|fixme|xxx+|lorem|"
    r"insertar|por completar|rellenar|su nombre|nombre de|à compléter|à remplir|insérer|votre|platzhalter|einfügen|einsetzen|eintragen|add |ausfüllen|ihr name|name hier"
)
_BRACKET = re.compile(rf"[\[(<](?:[^\[\]()<>]{{0,60}}\b)?(?:{_HINT})[^\[\]()<>]{{0,60}}[\])>]")
_FILLER = re.compile(
    r"\A\W*(?:"
    r"(?:this is )?(?:a |some |just )?(?:sample|placeholder|dummy|filler|example) (?:paragraph|text|copy|content|sentence|title|heading)s?(?:,? (?:to be )?replace[d]?.*)?|"
    r"here will be (?:some|the|your) \w+|(?:some |more )?(?:text|content|copy|description) (?:goes|comes|will be|to come|to follow|coming) ?(?:here|soon)?|"
    r"(?:your|my|add|put|insert|enter|type|write) (?:\w+ ){0,2}(?:text|title|name|description|content|something|here)(?: here)?|"
    r"texte? (?:provisoire|de remplissage|factice|à venir)|(?:este es un |esto es un )?texto (?:de relleno|provisional|de ejemplo)|contenido (?:de relleno|pendiente)|"
    r"(?:dies ist ein |das ist ein |hier steht ein )?(?:blindtext|platzhalter(?:text)?|fülltext|mustertext|beispieltext)|hier (?:kommt|steht|folgt) (?:noch )?(?:ein |der )?text|"
    r"ceci est un texte[\w ]*|(?:to be (?:filled in|completed|added|written|announced|determined)|coming soon|under construction|content coming soon)|"
    r"(?:todo|fixme|tbd|tba|xxx+)\b(?!\w)(?: ?: ?.*| (?:replace|write|add|fill|insert|complete|check|remove|before|later|finish|update)\b.*)?|x{3,}.{0,40}x{3,}|n/?a n/?a.*|"
    r"(?:sub)?(?:heading|title)(?: \d)?|caption|item|(?:sub)?heading(?:\W+(?:(?:sub)?heading|caption|item|title))+"
    r")\W*\Z"
)
_GOES_HERE = re.compile(r"\b(?:title|text|content|names?|description|copy|logo|image|picture|caption|heading|quote|link) (?:goes|go|comes|belongs) here\b")
_NONE = re.compile(r"\A(?:(?:undefined|null|nan|none|\[object object\]|nil|true|false)\W*){2,}\Z")
_SCRIPT = re.compile(
    r"<noscript|"
    r"\b(?:java)?scripts?(?:ing)?\b[^.]{0,40}\b(?:is|are|was|were|seems?|must be|needs? to be|has to be|being|turned|switched)\b[^.]{0,20}\b(?:disabled|off|blocked|required|needed|enabled|allowed|activated|on|missing|unavailable)\b|"
    r"\b(?:enable|allow|activate|turn on|switch on|permit|unblock)\b[^.]{0,30}\b(?:java)?script(?:s|ing)?\b|"
    r"\b(?:requires?|needs?|depends on|relies on|works? only with|only works with|does not work without|cannot (?:run|work|load) without|not possible without|without)\b[^.]{0,20}\b(?:java)?script(?:s|ing)?\b|"
    r"\bscript(?:ing)? settings\b|\bhas them (?:turned|switched) off\b|\bchange the settings of your browser\b|\bscript(?:s|ing)? switched on\b|"
    r"\bchecking (?:that )?(?:your browser|you are|if the site)|\bverif(?:y|ying) (?:that )?(?:you are|your browser)|\bare you (?:a )?(?:human|robot)|\bcookies must be\b|\benable cookies\b|"
    r"\baktivieren sie (?:bitte )?(?:javascript|cookies|skripte)|\b(?:javascript|skripte?) (?:ist|sind|muss|müssen)\b[^.]{0,40}\b(?:deaktiviert|ausgeschaltet|aktiviert|blockiert|abgeschaltet|eingeschaltet)|\bihr(?:en)? browser (?:wird )?(?:geprüft|überprüft)|"
    r"\bactiver (?:le )?javascript|\bjavascript (?:est|doit)\b[^.]{0,30}\b(?:désactivé|activé|bloqué|requis|nécessaire)|\bactiv(?:e|ar|en) javascript|\bhabilit(?:e|ar) javascript|\bjavascript (?:está|debe)\b"
)
# Reports name a script notice: who reports it and how, or a notice that is itself spoken of, stands before it; or what becomes of pages with it stands around it.
_REPORTS_SCRIPT = re.compile(
    r"\b(?:crawl(?:er)?|log|ticket|bug|test|report|changelog|guide|documentation|audit)s?(?: (?!(?:is|are|was|were|be|you|can|will)\b)[\w'-]+){0,4} "
    r"(?:lists|listed|reports|reported|says|said|explains|explained|describes|described|documents|documented|mentions|mentioned|notes|noted|states|counts|counted|dropped|found|caught|shows|showed)\b|"
    r"(?<!this is )\b(?:an?|the) (?:request|notice|message|banner|hint|warning|prompt) (?:to|that|about|saying)(?: \w+){0,3} ?\Z"
)
_PAGES_WITH_SCRIPT = re.compile(r"\b(?:pages|sites|documents|responses|requests|runs|cases|tests)\b")
_PAGES_TREATED = re.compile(r"\bw(?:as|ere) (?:\w+ )?(?:dropped|caught|retried|logged|counted|filtered|reported|listed|excluded|skipped|fixed)\b")
_STATUS = re.compile(
    rf"\A\W*(?:(?:http|error|err|fehler|erreur|code|status)[ /:#-]*(?:\d\.\d )?)?0{{3}}\W{{1,3}}(?:{REASONS})\s*(?:\Z|[.:|–—!-])|\A\W*(?:{REASONS})\W*\Z|"
    r"\A\W*(?:http|error|fehler|erreur|error code)[ :#-]*0{1,5} ?(?:[|:–—-]|\.(?!\d)|\Z)|<title>\s*(?:(?:error|http|fehler|erreur)\s*)?0{3,5}\b"
)
_HEAD = re.compile(r"\A\W*0{3}\s*[|:–—.-]\s*")
_JSON_ERROR = re.compile(r'\A\{\s*"(?:status|error|code|message|detail|title|errors|type|success)"\s*:.*"(?:status|error|code|message|detail)"\s*:.*\}\W*\Z')
# Customary texts of error pages, by language.
NOTICES = frozenset(
    x.strip()
    for x in """access denied|permission denied|you do not have permission to view this page|you do not have permission to access this page|you don't have permission to access this resource|
    your session has expired|your session has timed out|page not found|this page could not be found|the page you are looking for has been moved or deleted|the page you requested could not be found|
    the page you are looking for does not exist|something went wrong|something broke on our side|an error occurred|an error has occurred|an unexpected error occurred|an unexpected error has occurred|an internal error occurred|
    internal server error|bad gateway|service unavailable|this service is temporarily unavailable|the service is temporarily unavailable|this site is temporarily unavailable|could not connect to the database|
    error establishing a database connection|too many requests|you have hit the rate limit|this content is not available in your region|this content is not available in your country|your browser is not supported|
    this site is down for maintenance|this site is under maintenance|the requested url was not found on this server|the requested resource was not found|
    seite nicht gefunden|die seite wurde nicht gefunden|zugriff verweigert|interner serverfehler|ihre sitzung ist abgelaufen|dieser dienst ist derzeit nicht verfügbar|zu viele anfragen|wartungsarbeiten|
    page introuvable|page non trouvée|erreur interne du serveur|accès refusé|accès interdit|votre session a expiré|service temporairement indisponible|trop de requêtes|site en maintenance|
    página no encontrada|error interno del servidor|acceso denegado|su sesión ha caducado|su sesión ha expirado|servicio no disponible|demasiadas solicitudes|
    pagina non trovata|errore interno del server|accesso negato|la sessione è scaduta|servizio non disponibile|
    página não encontrada|erro interno do servidor|acesso negado|a sua sessão expirou|serviço indisponível|
    pagina niet gevonden|toegang geweigerd|interne serverfout|uw sessie is verlopen|
    nie znaleziono strony|strona nie została znaleziona|dostęp zabroniony|wewnętrzny błąd serwera""".split("|")
)
#: What may follow such a text in the same sentence: a mark, or a word that gives the cause or asks for something.
_AFTER_NOTICE = re.compile(r"\W*\Z|\s*[.,;:!(|–—-]|\s+(?:because|or|due|please|for|on|in|while|until|wegen|weil|bitte|à cause|en raison|veuillez|debido|por)\b")
_TRACE = re.compile(r"\A\W*(?:traceback \(most recent call last\):|exception in thread \"|fatal error: uncaught )")
_TICKED = re.compile(r"(?<!`)(`+)(?!`).+?(?<!`)\1(?!`)")
#: Stands for inline code: neither a word nor a mark that rules skip.
_CODE_MARK = " 0§0 "
# A slot that is spoken of: the words before or behind it name it as a slot, or as what a template replaces.
_NAMED_BEFORE = re.compile(
    r"(?:\b(?:slots?|placeholders?|template variables?)(?: (?:named|called|like|such as))?|"
    r"\b(?:template|renderer|formatter|parser|template engine)s? (?:\w+ )?(?:fills|replaces|substitutes|expands|renders|fill|replace|substitute|expand|render)(?: in)?(?: (?:the|each|every))?|"
    r"§(?:,|,? and|,? or)?) ?[\"'“„«(]?\Z"
)
_NAMED_BEHIND = re.compile(r"[\"'”“»)]? (?:style )?(?:slots?|placeholders?|template variables?)\b")


def _slots_left(prose: str) -> bool | None:
    """True: a slot stands in place of content; False: slots are only spoken of; None: there is none."""
    plain = _CODE.sub(" ", prose)
    found = [m for pattern in (_SLOTS, _BRACKET) for m in pattern.finditer(plain)]
    found += [m for m in _ANGLE.finditer(plain) if m[1] not in TAGS and f"</{m[1]}>" not in plain]
    found += [m for m in _SPACED_ANGLE.finditer(plain) if m[1] not in TAGS]
    dollars = list(_DOLLARS.finditer(prose))
    for text, slots in ((plain, sorted(found, key=lambda m: (m.start(), -m.end()))), (prose, dollars)):
        end = -100
        for m in slots:
            if m.end() <= end:  # part of the slot before
                continue
            before = "§" + text[end : m.start()].lstrip("\"'”“»)") if m.start() - end < 10 else text[max(0, m.start() - 80) : m.start()]
            if not (_NAMED_BEFORE.search(before) or _NAMED_BEHIND.match(text, m.end())):
                return True
            end = m.end()
    return False if found or dollars else None


def _script_notice(prose: str) -> bool | None:
    """True: a notice about scripts; False: such notices are only reported; None: there is none."""
    notice = None
    for m in _SCRIPT.finditer(prose):
        before, behind = prose[: m.start()], prose[m.end() :]
        if not (_REPORTS_SCRIPT.search(before) or _PAGES_WITH_SCRIPT.search(before) and _PAGES_TREATED.search(behind)):
            return True
        notice = False
    return notice


def _customary(text: str) -> bool:
    """Does the passage, or what is left of it without an interjection, begin with one of NOTICES and say no more than its cause?"""
    for part in {text, _message(text)}:
        message = part.strip(" .!?,;:|–—-\"'()")
        words = message.split(" ")
        for n in range(min(len(words), 13), 0, -1):
            if (start := " ".join(words[:n]).rstrip(".,;:!?()|–—-")) in NOTICES:
                if len(words) <= n + 12 and _AFTER_NOTICE.match(message[len(start) :]):
                    return True
                break
    return False


def trusted(passage: str) -> int:
    """1: residue as a whole, 2: holds residue beside other words, -1: sound writing about such things, 0: neither is sure.

    The passage is as passages() gives it. Inline code is no content of its own; all rules see what is left without it.
    """
    text = passage
    if "&" in text:
        text = html.unescape(text)
    prose = _TICKED.sub(_CODE_MARK, text).strip() if "`" in text else text
    slots = _slots_left(prose)
    if slots:
        return 2
    words = re.findall(r"[^\W\d_]+", prose)
    if len(words) >= FILLER_WORDS:
        if sum(w in LATIN for w in words) >= FILLER_SHARE * len(words) or sum(w in KEYS for w in words) >= FILLER_SHARE * len(words):
            return 1
        if len(words) > 5 and len(set(words)) == 1:
            return 1
    if _FILLER.match(prose) or _NONE.match(prose):
        return 1
    if _GOES_HERE.search(prose):
        return 2
    bare = re.sub(r"<[^<>]*>", " ", prose).strip() or prose
    bare = _HEAD.sub("", bare) or bare
    if _STATUS.search(prose) or _STATUS.match(bare) or _JSON_ERROR.match(prose) or _TRACE.match(prose) or _customary(bare):
        return 1
    notice = _script_notice(prose)
    if notice:
        return 1
    in_code = prose != text and _slots_left(text.replace("`", " ")) is not None
    return -1 if slots is False or notice is False or in_code else 0


# What stands before the message of a passage: a status with its reason, or up to three words set off by a mark.
_CORE_HEAD = re.compile(
    rf"\A(?:\W*(?:<[^<>]*>\s*)*(?:(?:http|error|err|fehler|erreur|code|status)[ /:#-]*)?\b0{{1,4}}\b\s*(?:{REASONS})?\s*(?:[|:.–—-]\s*|\Z)|"
    r"\W*[^\W\d_]+(?: [^\W\d_]+){0,2}\s?(?:[:!|–—]|,|-(?=\s))\s*)"
)
_WORD = re.compile(r"\w+")


def _message(passage: str) -> str:
    """A passage without its status head or interjection, if at least two words are left."""
    m = _CORE_HEAD.match(passage)
    return passage[m.end() :] if m and " " in passage[m.end() :].strip() else passage


def core(passage: str) -> str:
    """The words of its message, one blank apart."""
    return " ".join(_WORD.findall(_message(passage)))


_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(int(_P), k, 1 << 64) for k in range(SHINGLE)], dtype=np.uint64)


def shingle_hashes(cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the runs of SHINGLE words of all cores, where each core's begin). A core of fewer words is one run."""
    flat = " ".join(cores).split(" ")
    codes, known = pd.factorize(np.array(flat, dtype=object))
    h = np.array([xxhash.xxh64_intdigest(w) for w in known], dtype=np.uint64)[codes]
    n = np.array([c.count(" ") + 1 for c in cores])
    first = np.cumsum(n) - n
    runs = np.maximum(n - SHINGLE + 1, 1)
    starts = np.cumsum(runs) - runs
    at = np.repeat(first - starts, runs) + np.arange(runs.sum())
    left = np.repeat(np.minimum(n, SHINGLE), runs)
    padded = np.append(h, np.zeros(SHINGLE, np.uint64))
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(SHINGLE):
        total += np.where(k < left, padded[at + k] * _POWERS[k], np.uint64(0))
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29)), starts


def simhashes(cores: list[str]) -> np.ndarray:
    """One 64-bit SimHash per core, as signed integers: each bit is the majority of its shingles' bits."""
    hashes, starts = shingle_hashes(cores)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    runs = np.diff(np.append(starts, len(hashes)))
    return np.packbits(votes * 2 > runs[:, None], axis=1).view(np.int64).reshape(-1)


def similar(a: str, b: str) -> bool:
    """Do two cores share SIMILARITY of their shingles?"""
    if a == b:
        return True
    hashes, starts = shingle_hashes([a, b])
    x, y = set(hashes[: starts[1]].tolist()), set(hashes[starts[1] :].tolist())
    return len(x & y) >= SIMILARITY * len(x | y)


_JUDGED = T.StructType([T.StructField("label", T.ByteType()), T.StructField("node", T.LongType()), T.StructField("sim", T.LongType())])


@F.pandas_udf(_JUDGED)
def _judged(passage: pd.Series, sign: pd.Series) -> pd.DataFrame:
    """Label, node and SimHash: the node is the hash of the core, null if that has fewer than CORE_WORDS words."""
    labels = [trusted(p) if s else 0 for p, s in zip(passage, sign, strict=True)]
    cores = [core(p) for p in passage]
    nodes = pd.Series([xxhash.xxh64_intdigest(c) if c.count(" ") >= CORE_WORDS - 1 else None for c in cores], dtype="UInt64")
    sims = simhashes(cores) if cores else np.zeros(0, np.int64)
    signed = pd.Series(nodes.fillna(0).to_numpy(dtype=np.uint64).view(np.int64), dtype="Int64").mask(nodes.isna())
    return pd.DataFrame({"label": np.array(labels, dtype=np.int8), "node": signed, "sim": sims})


@F.pandas_udf(T.BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar(core(x), core(y)) for x, y in zip(a, b, strict=True)], dtype="bool")


# What every passage has on which a rule of trusted() can hold; those without are not handed to the rules. Fillers begin so.
_SIGNS = (
    r"[\[{<$@#%`\\&]|\([^()]*[a-z]|__|\.{8}|\b(\w+)(?:\W+\1\b){2}|\A\W*(?:http|err|fehler|code|status|0)|"
    r"\A\W*(?:(?:this is |a |some |just |more )*(?:sample|placeholder|dummy|filler|example|text|content|copy|description)|here will|your|my|add|put|insert|enter|type|write|texte?|este es|esto es|contenido|"
    r"dies ist|das ist|hier|ceci est|to be|coming|under|todo|fixme|tb[da]|xx|n/?a|subheading|heading|subtitle|title|caption|item)\b|\A\W*xx"
)
_SIGN_WORDS = (
    "script|javascript|noscript|skript|cookies|browser|human|robot|checking|verify|traceback (|exception in thread|fatal error|todo|fixme|xxx|n/a|undefined|null|nan|none|nil|true|false|"
    "goes here|go here|comes here|belongs here|blindtext|platzhalter|fülltext|mustertext|beispieltext|foo bar|bar baz|bla bla|zzz zzz"
).split("|")


def _signs() -> str:
    """One pattern of the signs, the words above, dummy words, status reasons and the beginnings of NOTICES. Words are grouped by their first letter."""
    reasons = [r.replace("time-?out", "time") for r in REASONS.split("|")]
    words = {*_SIGN_WORDS, *(w for w in LATIN | KEYS if len(w) > 3), *(" ".join(n.split()[:3]) for n in NOTICES), *reasons}
    groups: dict[str, list[str]] = {}
    for w in sorted(words):
        if not any(w != v and w.startswith(v) for v in words):
            groups.setdefault(w[0], []).append(re.escape(w[1:]))
    return _SIGNS + r"|\b(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items()) + ")"


def passages(text: Column) -> Column:
    """Lines and sentences, lower-cased, digits as 0, blanks collapsed; code blocks are left out. Slots in capitals get double brackets."""
    plain = F.when(text.contains("```"), F.regexp_replace(text, _FENCE, "\n")).otherwise(text)
    slots = F.regexp_replace(plain, rf"(?<![\[`])\[(?!(?:{_LEVELS})\])(\p{{Lu}}[\p{{Lu}}_ ]{{2,40}})\](?![\](`])", "[[$1]]")
    plain = F.regexp_replace(F.when(text.contains("["), slots).otherwise(plain), r"[­​-‍﻿]", "")
    norm = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(plain), "[1-9]", "0"), _BLANKS, " "), " {2,}", " ")
    return F.filter(F.transform(F.split(norm, r"[\r\n]+|(?<=[.!?]) "), lambda p: F.trim(p)), lambda p: p != "")


def blocks_for(n: int) -> int:
    """Blocks that the 64 bits are cut into. HAMMING differing bits leave all but HAMMING blocks equal; the more
    passages there are, the more bits must agree, so that a bucket stays small. Every choice finds the same links."""
    return next((m for m in (4, 5, 6, 7) if n <= 1 << (64 * (m - HAMMING) // m + 4)), 8)


def table_keys(sim: Column, m: int) -> Column:
    """One key per SimHash table: the table's number and the bits that must agree."""
    edges = [64 * i // m for i in range(m + 1)]
    keys = []
    for t, chosen in enumerate(itertools.combinations(range(m), m - HAMMING)):
        mask = 0
        for b in chosen:
            mask |= ((1 << (edges[b + 1] - edges[b])) - 1) << edges[b]
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.struct(F.lit(t).alias("table"), sim.bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def spread(judged: DataFrame) -> DataFrame:
    """(id) of the passages that are residue, by spreading label 1 through the components of near-duplicates.

    judged: (id, passage, label, node, sim), a row per passage. Passages that only hold residue (label 2) are
    residue but do not pass the label on: what is like the rest of them is sound. Passages of label -1 neither
    receive nor pass it, nor do those without a node.

    A node is a distinct core. A node with a trusted passage is residue, and so is every passage of a residue
    node. Nodes within HAMMING bits share a key of the SimHash tables; such pairs are verified by that distance in
    the join and then by the similarity of their shingles. Only nodes next to a residue node are compared, hop by
    hop until no node is reached, so pairs among sound ones are never formed; equal cores are one node.
    """
    linked = judged.where("label in (0, 1) and node is not null")
    m = blocks_for(linked.count())
    keys = F.explode(F.transform(table_keys(F.col("sim"), m), lambda k: F.xxhash64(k["table"], k["bits"]))).alias("key")
    seeds = linked.where("label = 1").groupBy("node").agg(F.min("passage").alias("passage"), F.first("sim").alias("sim"))
    frontier = cut(seeds)
    reached = cut(frontier.select("node"))
    while True:
        f = frontier.select(F.col("node").alias("fnode"), F.col("sim").alias("fsim"), keys)
        near = (F.bit_count(F.col("sim").bitwiseXOR(F.col("fsim"))) <= HAMMING) & (F.col("node") != F.col("fnode"))
        open_ = linked.where("label = 0").select("node", "sim", keys)
        pairs = cut(open_.join(small_side(f), "key").where(near).select("node", "fnode").distinct())
        met = None
        if not pairs.isEmpty():
            texts = linked.where("label = 0").join(small_side(cut(pairs.select("node").distinct())), "node", "left_semi").groupBy("node").agg(F.min("passage").alias("passage"), F.first("sim").alias("sim"))
            both = pairs.join(texts, "node").join(small_side(frontier.select(F.col("node").alias("fnode"), F.col("passage").alias("fpassage"))), "fnode")
            met = cut(both.where(_similar("passage", "fpassage")).groupBy("node").agg(F.first("passage").alias("passage"), F.first("sim").alias("sim")).join(reached, "node", "left_anti"))
        if met is None or met.isEmpty():
            break
        frontier, reached = met, cut(reached.unionByName(met.select("node")))
    held = judged.where("label > 0").select("id")
    return held.unionByName(linked.where("label = 0").join(small_side(reached), "node", "left_semi").select("id"))


def judge_passages(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(id, passage, label, node, sim) of the distinct passages: the label is trusted()'s, 0 without asking for what shows no sign."""
    each = docs.select(F.explode(passages(F.col(f"`{text_col}`").cast("string"))).alias("passage")).distinct()
    return each.select(F.xxhash64("passage").alias("id"), "passage", _judged("passage", F.col("passage").rlike(_signs())).alias("j")).select("id", "passage", "j.*")


def find_residue(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_col): documents that hold residue. Null and empty texts hold none; repeated documents come out each
    time only if their ids differ; an empty table gives an empty table; other columns are ignored. Passages are
    told apart by a 64-bit hash of their text."""
    residue = cut(spread(cut(judge_passages(docs, text_col))))
    # A passage may be in any number of documents: the list of residue passages is distinct, the documents are not gathered by it.
    ids = F.array_distinct(F.transform(passages(F.col(f"`{text_col}`").cast("string")), lambda p: F.xxhash64(p)))
    long = docs.select(F.col(f"`{doc_col}`").alias("doc"), F.explode(ids).alias("id"))
    return long.join(small_side(residue), "id", "left_semi").select(F.col("doc").alias(doc_col)).distinct()
