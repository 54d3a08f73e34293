"""Broken pairs of prompt and response, each with its one kind of defect.

copied_prompt: the response is compressed with the prompt as zstandard dictionary, both
    without case, spacing, quoting and markup; what the dictionary doesn't give is what the
    response adds. A copy adds a few bytes of framing.
refusal: a phrase of the refusal dictionary, and nothing but courtesies and reasons beside it, however
    long the text is.
other_language: words of the dictionaries of frequent words, or the script, say another
    language than the one that the prompt asks for or, if it asks for none, is written in.
empty, truncated: the terminal context (terminal.py) and the self-join by prefix (truncation.py).

The first that holds of empty, copied_prompt, refusal, truncated, other_language is the
defect. finish_reason and output_tokens aren't used, since they aren't always right.

Defined results: null content is empty; a null or empty prompt can be neither copied nor of
another language; of several deliveries of one key the last counts; a null key is no record.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import terminal, truncation
from siltstone.llm.common import map_batches
from siltstone.session import written

# Frequent words of the languages, names of languages, phrases that decline.
FREQUENT = {
    "en": "the of and to in is that for with as was by on are it this be which not from has have after before when until who most them no longer its state only so an what would if around given list describe explain write use keep under text happened other files each",
    "de": "der die das und ist nicht von zu den mit dem des im für auf ein eine wird werden wurden wurde haben hat noch vor nach während weil wer wir wie was sich jetzt auch dieser diese diesen ich bei aus welche lässt offen fasse kurz beschreibe hat haben",
    "fr": "le la les des et est un une du dans que qui pour pas sur au avec ce cette ne plus par nous avons être sont dès après avant même à il reste où rien fois encore quels quelles cas après résume rédige laisse elle a",
    "es": "el la los las de y que en un una es por con no se para del al lo como más su está porque también ahora antes después quién según todavía esta este hemos tras qué casos deja escribe resume cambió",
    "pt": "o a os as de e que em um uma é por com não se para do da ao como mais sua está porque também agora antes depois quem ainda esta este foi nenhuma nos na no quais escreva resuma após",
    "it": "il lo la gli le di e che in un una è per con non si del della al come più sua perché anche ora prima dopo chi ancora questo questa sono stato nel",
    "nl": "de het een en van is dat niet in op te voor met zijn die er aan ook als maar om nog wordt worden deze dit naar bij door wij heeft",
}
NAMES = {
    "en": "english englisch anglais inglés ingles inglês английском 英文 英语",
    "de": "german deutsch allemand alemán aleman alemão немецком 德文 德语",
    "fr": "french französisch français francais francés francês французском 法文 法语",
    "es": "spanish spanisch espagnol español espanol espanhol испанском 西班牙文 西班牙语",
    "pt": "portuguese portugiesisch portugais portugués português португальском 葡萄牙文 葡萄牙语",
    "it": "italian italienisch italien italiano итальянском 意大利文 意大利语",
    "nl": "dutch niederländisch néerlandais holandés holandês голландском 荷兰文 荷兰语",
    "ru": "russian russisch russe ruso russo русском 俄文 俄语",
    "zh": "chinese chinesisch chinois chino chinês китайском 中文 汉语",
    "ja": "japanese japanisch japonais japonés japonês японском 日文 日语",
}
REFUSALS = [
    r"\bi(?:'m| am) (?:sorry,? but i )?(?:un|not )able to\b",
    r"\bi(?:'m| am) not (?:allowed|permitted|comfortable|willing)\b",
    r"\bi (?:can(?:'t|not| not)|won't|will not|could not|couldn't|do not|don't) (?:help|assist|comply|share|be producing|provide|produce|write|answer|feel comfortable|discuss|do that|fulfil|continue|complete|describe)\b",
    r"\bi(?:'d| would) rather not\b",
    r"\bi (?:must|have to|need to|will have to) (?:decline|refuse|pass)\b",
    r"\b(?:it )?(?:isn't|is not) possible for me\b",
    r"\boutside what i am allowed\b",
    r"\bsomething i (?:have to|must|need to) (?:decline|refuse)\b",
    r"\b(?:kann|darf) ich (?:\w+ ){0,3}nicht\b",
    r"\bich (?:kann|darf) (?:\w+ ){0,5}nicht\b",
    r"\bdarf ich nicht\b",
    r"\bich (?:muss|möchte) (?:\w+ ){0,4}(?:ablehnen|verweigern)\b",
    r"\bnicht (?:in der lage|möglich, ihnen)\b",
    r"\bje (?:ne peux|ne suis) pas\b",
    r"\bje (?:dois|préfère) (?:décliner|refuser|ne pas)\b",
    r"\bil ne m'est pas (?:possible|permis)\b",
    r"\bno (?:me )?(?:puedo|es posible|está permitido)\b",
    r"\b(?:debo|tengo que|prefiero) (?:rechazar|negarme|declinar|no )",
    r"\bnão (?:posso|consigo|me é permitido|estou autorizad\w)\b",
    r"\b(?:devo|tenho que|preciso) (?:recusar|declinar)\b",
    r"\bя не (?:могу|имею|вправе|смогу)\b",
    r"\bмне не (?:разрешено|позволено)\b",
    r"\b(?:вынужден\w*|должен|должна|приходится) (?:\w+ )?отк(?:азать|лонить)",
    r"无法(?:协助|帮助|完成|撰写|提供|回答)|不能(?:撰写|协助|帮助|提供|回答|完成)|不(?:被)?允许(?:我)?|必须拒绝|拒绝(?:此|该|这)|不便(?:回答|提供)",
]
#: A phrase can only be where one of its words is; looking for these first spares most of the search.
KEYS = (
    ("able to",), ("allowed", "permitted", "comfortable", "willing"), ("can't", "cannot", "can not", "won't", "will not", "not", "n't"), ("rather not",), ("decline", "refuse", "pass"), ("possible for me",), ("outside what",),
    ("something i",), ("nicht",), ("nicht",), ("darf ich",), ("ablehnen", "verweigern"), ("nicht",), ("je ne ",), ("je dois", "je préfère"), ("il ne m'est",), ("puedo", "es posible", "está permitido"), ("debo ", "tengo que ", "prefiero "),
    ("não",), ("recusar", "declinar"), ("я не ",), ("мне не ",), ("отказать", "отклонить"), ("无法", "不能", "允许", "拒绝", "不便"),
)
assert len(KEYS) == len(REFUSALS)
_refusals = [(k, re.compile(p)) for k, p in zip(KEYS, REFUSALS)]


def refuses(text: str) -> bool:
    """Whether a phrase of the refusal dictionary is in the text, which is in lower case."""
    return any(any(k in text for k in keys) and p.search(text) for keys, p in _refusals)


#: What may stand beside a refusal: regrets, reasons, offers of other help.
COURTESIES = [
    r"(?:i(?:'m| am) (?:very |so |truly )?sorry|sorry|(?:my |i )?apolog\w+|unfortunately|regrettably|thank you|thanks|i understand|i appreciate)\b",
    r"(?:it|this|that|these|those|they|doing so|(?:the|your|its) (?:content|material|text|prompt|request|question|topic)) (?:would|was|were|goes|go|falls|fall|lies|lie|could|may|might|is|are) (?:\w+ ){0,3}(?:mean|require|against|outside|beyond|violate|breach|not (?:allowed|permitted)|unsafe|harmful|private|confidential|blocked)\b",
    r"(?:please|kindly) (?:contact|ask|consult|reach|let me know|feel free|rephrase|try|provide|share|send)\b",
    r"(?:perhaps|maybe|you (?:could|can|may|might)) (?:\w+ ){0,2}(?:try|ask|rephrase|contact|consult|send)\b",
    r"(?:is there|let me know|feel free|if (?:there is|there's|you (?:have|need|want|would|can)))\b",
    r"i(?:'d| would| will|'ll|'m| am)? ?(?:can |could |be )?(?:happy|glad|offer|instead)\b",
    r"(?:es tut mir leid|tut mir leid|leider|entschuldig\w+|verzeih\w+|danke|bitte (?:wend|frag|kontakt|versuch)\w*|gern\w* (?:helfe|kann) ich)\b",
    r"(?:désolé\w*|je suis désolé\w*|malheureusement|merci|veuillez)\b",
    r"(?:lo siento|lamentablemente|por desgracia|gracias|por favor|sinto muito|desculpe|infelizmente|obrigad\w|lamento)\b",
    r"(?:извините|простите|к сожалению|спасибо|пожалуйста)\b",
    r"(?:抱歉|对不起|很遗憾|谢谢|请联系)",
]
COURTESY = re.compile(r"[\s\W]*(?:%s)" % "|".join(COURTESIES))
SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|[;；—]|,?\s\b(?:but|however|although|though|aber|jedoch|mais|pero|mas|porém|но|однако)\b|[,，]?(?:但是|但|不过)")
ITEM = re.compile(r"\s*(?:\||[-*] )")
SPAN = re.compile(r"```.*?(?:```|\Z)|`[^`]*`|https?://\S+", re.S)
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: Letters and marks of one of the languages only.
LETTERS = {"de": "äöüßÄÖÜ", "es": "ñ¿¡", "pt": "ãõ"}
_words = {k: frozenset(v.split()) for k, v in FREQUENT.items()}
_languages = {w: tuple(k for k, v in _words.items() if w in v) for w in frozenset().union(*_words.values())}
#: Ideographs, kana and Cyrillic letters.
SCRIPTS = tuple(re.compile(p) for p in ("[一-鿿]+", "[぀-ヿ]+", "[Ѐ-ӿ]+"))
_names = {n: k for k, v in NAMES.items() for n in v.split()}
ASKS = re.compile(
    r"(?:\b(?:answer|reply|respond|write|written|text must be|output|language|antworte|schreib\w*|sprache|réponds|répondez|rédig\w*|langue|responde|escrib\w*|idioma|responda|escreva|ответь\w*|напиши\w*|язык\w*)\b[^.?!。\n]{0,40}?|\bin |\bauf |\ben |\bem |на |[用以])(?P<name>%s)" % "|".join(sorted(map(re.escape, _names), key=len, reverse=True)),
    re.I,
)
LOOSE = re.compile(r"[\W_]+")
#: Bytes that a copy may add to its prompt, but for CHANGED of it, and the least share of the response that the prompt must give.
FRAMING, CHANGED, COPIED = 48, 0.02, 0.5


def language(text: str, least: int = 1) -> str | None:
    """The language of prose, None if it can't be told. Code spans, headings, table rows and front matter don't count."""
    text = SPAN.sub(" ", terminal.FRONT.sub("", text, count=1))
    text = "\n".join(x for x in text.split("\n") if not terminal.HEADING.match(x) and not x.lstrip().startswith(("|", "*Phase", "//")))
    lower = text.lower()
    ws = WORD.findall(lower)
    if not text.isascii():
        han, kana, cyrillic = (sum(map(len, p.findall(text))) for p in SCRIPTS)
        if kana > 2:
            return "ja"
        if han > 3 and han * 2 > len(ws):
            return "zh"
        if cyrillic > 8 and cyrillic * 2 > sum(map(len, ws)):
            return "ru"
    score = dict.fromkeys(_words, 0)
    get = _languages.get
    for w in ws:
        for k in get(w, ()):
            score[k] += 1
    if not text.isascii():
        for k, letters in LETTERS.items():
            score[k] += min(2, sum(map(text.count, letters)))
    best = max(score, key=score.__getitem__)
    rest = max((v for k, v in score.items() if k != best), default=0)
    return best if score[best] >= least and score[best] > rest else None


def wanted(prompt: str) -> str | None:
    """The language that a prompt asks for, else its own."""
    plain = SPAN.sub(" ", prompt)
    asked = [m["name"].lower() for m in ASKS.finditer(plain)]
    return _names[asked[-1]] if asked else language(prompt)


def loose(text: str) -> bytes:
    """Text without case, spacing, quoting, punctuation and markup."""
    return LOOSE.sub(" ", text.lower()).strip().encode()


def copied(prompt: str, content: str) -> bool:
    """Whether the response gives nothing beyond its prompt."""
    p, c = loose(prompt), loose(content)
    if not c:
        return False
    # A word that the prompt doesn't have costs two bytes at least.
    if 2 * len(set(c.split()) - set(p.split())) > min(FRAMING + CHANGED * len(c), (1 - COPIED) * len(c)):
        return False
    own = zstandard.ZstdCompressionDict(p, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(3, source_size=len(c), dict_size=len(p), write_content_size=False, write_checksum=False, write_dict_id=False)
    added = len(zstandard.ZstdCompressor(dict_data=own, compression_params=params).compress(c))
    return added <= FRAMING + CHANGED * len(c) and added <= (1 - COPIED) * len(c)


def declines(content: str) -> bool:
    """Whether the response declines and does nothing else.

    Nothing may be left beside refusals, courtesies and reasons; the items of a list belong to the
    line that introduces it.
    """
    lines = [x for x in content.split("\n") if x.strip() and not terminal.HEADING.match(x)]
    plain = " ".join(lines)
    if not refuses((SPAN.sub("x", plain) if "`" in plain else plain).lower().replace("’", "'")):
        return False
    items = [bool(ITEM.match(x)) for x in lines]
    if "```" in content:
        return False
    # Lines of a sentence that is wrapped are put together.
    parts: list[tuple[bool, str]] = []
    for x, item in zip(lines, items):
        if parts and not item and not parts[-1][0] and not parts[-1][1].rstrip().endswith((".", "!", "?", ":", "。", "！", "？", "：")):
            parts[-1] = False, f"{parts[-1][1]} {x}"
        else:
            parts.append((item, x))
    introduced = declined = False
    for item, x in parts:
        if item and introduced:
            continue
        said = [c for c in SENTENCE.split(SPAN.sub("x", x).lower().replace("’", "'")) if WORD.search(c)]
        refused = [refuses(c) for c in said]
        if any(not r and not COURTESY.match(c) for c, r in zip(said, refused)):
            return False
        declined |= any(refused)
        introduced = bool(refused) and refused[-1] and x.rstrip().endswith((":", "："))
    return declined


def judge(prompt: str | None, content: str | None) -> tuple[str, str]:
    """(defect or "" or "line", unit): "line" leaves it to the other lines of the collection; an empty text may have a unit, too."""
    end, unit = terminal.state(content)
    if end == terminal.EMPTY:
        return "empty", unit
    assert content is not None
    if prompt and copied(prompt, content):
        return "copied_prompt", ""
    if declines(content):
        return "refusal", ""
    if end == terminal.OPEN:
        return "truncated", unit
    if end == terminal.LINE:
        return "line", unit
    return other(prompt, content), unit


def other(prompt: str | None, content: str) -> str:
    if prompt:
        want, got = wanted(prompt), language(content)
        if want and got and want != got:
            return "other_language"
    return ""


def judged(responses: DataFrame, key: str = "response_id", prompt: str = "prompt", content: str = "content", at: str = "loaded_at") -> DataFrame:
    """(key, defect, beside, unit, text_id, done), one row for each key; text_id is the hash of the content; beside is the defect if the unit isn't cut, done says that it isn't.

    Texts are judged where they are read; only the judgements are shuffled.
    """
    src = responses.where(F.col(key).isNotNull()).select(key, at, prompt, content, F.xxhash64(content).alias("text_id"))

    def make():  # noqa: ANN202
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for p, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                d, u = judge(p, c)
                rows.append((d, other(p, c) if d == "line" else d, u))
            d, o, u = (list(x) for x in zip(*rows))
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, pa.string()) for x in (d, o, u)], b.column(4)], names=[key, at, "defect", "beside", "unit", "text_id"])

        return batch

    kind = src.schema
    rows = map_batches(src, make, f"{key} {kind[key].dataType.simpleString()}, {at} {kind[at].dataType.simpleString()}, defect string, beside string, unit string, text_id long")
    last = rows.groupBy(key).agg(F.max_by(F.struct("defect", "beside", "unit", "text_id"), F.struct(at, "defect", "unit", "text_id")).alias("_r"))
    done = F.col("_r.defect").isin("", "other_language")
    return written(last.select(key, "_r.*", done.alias("done")), "judged")


def broken_pairs(responses: DataFrame, key: str = "response_id", prompt: str = "prompt", content: str = "content", at: str = "loaded_at") -> DataFrame:
    """(key, defect) of every broken pair."""
    return _broken(judged(responses, key, prompt, content, at), key).select(key, "defect")


def _broken(j: DataFrame, key: str) -> DataFrame:
    """(key, defect, text_id, line) of every broken pair; line says that the closing line told it."""
    cut = truncation.cut_units(j)
    sure = j.where("defect not in ('line', '') and not (defect = 'empty' and unit <> '')").select(key, "defect", "text_id", F.lit(False).alias("line"))
    asked = j.where("defect = 'line' or (defect = 'empty' and unit <> '')")
    found = asked.join(cut.withColumn("cut", F.lit(True)), "unit", "left")
    defect = F.when(F.col("cut"), "truncated").otherwise(F.col("beside"))
    return sure.unionByName(found.select(key, defect.alias("defect"), "text_id", F.coalesce("cut", F.lit(False)).alias("line")).where("defect <> ''"))


def truncated(responses: DataFrame, key: str = "response_id") -> DataFrame:
    """(key) of the responses that were cut off."""
    return broken_pairs(responses, key).where("defect = 'truncated'").select(key)


def truncated_ways(responses: DataFrame, configs: DataFrame, key: str = "response_id", content: str = "content", at: str = "loaded_at") -> DataFrame:
    """(key, way) of the responses that were cut off, by the first that knows it.

    "prefix": the content is a strict prefix of a longer one; "line": its closing line or lone heading is one;
    "limit": the end is open and output_tokens reach max_output_tokens of the configuration; "context": the end is open.
    """
    found = _broken(judged(responses, key, content=content, at=at), key).where("defect = 'truncated'")
    longer = truncation.continued(responses.select(F.xxhash64(content).alias("id"), F.col(content).alias("text")), found.select(F.col("text_id").alias("id")))
    used = responses.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct("config_id", "output_tokens"), F.struct(at, "config_id", "output_tokens")).alias("_u")).select(key, "_u.*")
    limits = configs.where("config_id is not null").groupBy("config_id").agg(F.max("max_output_tokens").alias("most"))
    full = found.select(key).join(used, key).join(limits, "config_id").where("output_tokens >= most").select(key, F.lit(True).alias("full"))
    told = found.join(longer.select(F.col("id").alias("text_id"), F.lit(True).alias("longer")).distinct(), "text_id", "left").join(full, key, "left")
    return told.select(key, F.when(F.col("longer"), "prefix").when(F.col("line"), "line").when(F.col("full"), "limit").otherwise("context").alias("way"))
