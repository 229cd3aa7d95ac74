"""Problem 1: broken prompt and response pairs.

Ordered rules over columnar batches: emptiness, copied prefixes and pieces of the prompt, multilingual refusal phrases,
unclosed delimiters and abrupt endings, mismatch of script and language. All patterns run as linear-time automata over
whole Arrow columns, words are looked up in one vocabulary per batch; there is one scan and no shuffle. `defects` holds
every triggered type in the order of the rules; the first is the pair's main defect.

Defined results
* A NULL response, or one of blanks, invisible characters, marks, placeholders or an empty JSON or fence shell is `empty`;
  an empty response triggers nothing else.
* A NULL or empty prompt has no language, no text to copy and asks for no field.
* `copy`: stretches of `piece` letters and digits of the response that the prompt contains (case, blanks and marks aside)
  make up half of the response, or a large piece (8 stretches).
* `refusal`: a refusal phrase anywhere in an answer without a label, or at the beginning of one with a label.
* `truncated`: unclosed delimiters, an end within a sentence, or no label although the prompt asks for one and the response
  is neither a refusal nor a copy.
* `other_language`: most letters are of another script than the prompt's, or the function words of another language prevail.
* Texts are judged whole; repeated rows are judged one by one; clashing columns `defects` and `defect` are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.registry import CLINICAL_CLASSES

#: The defect types in the order of the rules.
DEFECTS = ("empty", "copy", "refusal", "truncated", "other_language")

CLASSES = CLINICAL_CLASSES

PLACEHOLDERS = ("null", "none", "nil", "na", "nan", "n/a", "undefined", "empty", "tbd", "todo", "no answer", "no response", "json")

LABEL = r"(?i)\blabel\"?\s*[:=]\s*\"?\s*(-?\d+|" + "|".join(CLASSES) + r")\b"

#: Per language, phrases of somebody who will not, may not or cannot do what is asked: (phrases that say so by themselves,
#: negations, verbs of answering that a negation has to meet within a few words, in either order).
_REFUSING = {
    "en": (
        r"(?:must|have to|has to|need to|going to|choose to|i) (?:respectfully |politely )?(?:decline|refuse)|(?:do|does|would) not (?:allow|permit) me|(?:beyond|outside|against) (?:what i am|what i'm|my|the) (?:\w+ )?(?:allowed|permitted|able|scope|policy|policies|guidelines|rules)|not be (?:appropriate|right|responsible) (?:for me|to)|i(?: a|')m sorry,? but i|as an (?:ai|assistant|artificial|automated|language)[^.]* (?:not|cannot|can't)\b|i(?:'d| would)? (?:rather|prefer) not",
        r"can't|cannot|can not|couldn't|could not|unable to|not able to|not willing to|unwilling to|not allowed to|not permitted to|not in a position to|not comfortable|won't|will not|not going to",
        r"help|assist|answer|respond|reply|comply|classif\w*|label\w*|judge|choose|give|giving|provid\w*|offer\w*|decide|diagnos\w*|fulfil\w*|do (?:that|this|so)|comment|advise|assess|evaluate|make (?:\w+ )?(?:judg|assess|decis|diagnos)\w*",
    ),
    "de": (
        r"tut mir (?:sehr )?leid|bedaure|(?:muss|möchte|will) (?:\w+ ){0,5}(?:ablehnen|verzichten|verweigern)|(?:nicht|keine?n?) (?:\w+ )?(?:gestattet|erlaubt|zulässig|befugt)|lieber (?:nicht|keine?n?)",
        r"(?:kann|darf|werde|möchte|will|könnte)(?: ich)?(?: \w+){0,4}? (?:nicht|keine?n?)|nicht in der lage|außerstande",
        r"helfen|beantworten|antworten|einordnen|beurteilen|zuordnen|nachkommen|entscheiden|geben|abgeben|machen|stellen|klassifizieren|bewerten|einschätz\w*|beurteilung\w*|auskunft|antwort|diagnose\w*|rat|urteil",
    ),
    "fr": (
        r"désolée?s?|(?:dois|préfère|veux) (?:\w+ ){0,2}(?:décliner|refuser|m'abstenir)|(?:je )?refuse de|n[e'] ?(?:\w+'? ?){0,3}pas (?:permis|autorisée?|habilitée?|en mesure)|préfère ne pas|(?:préférerais|aimerais mieux) (?:ne pas|m'abstenir)|au-delà de ce qui m'est permis",
        r"ne (?:peux|puis|saurais|pourrai|veux|vais) pas|impossible de|incapable de",
        r"répondre|aider|donner|classer|fournir|attribuer|traiter|décider|juger|évaluer|choisir|me prononcer|poser",
    ),
    "es": (
        r"lo (?:siento|lamento)|(?:debo|tengo que|prefiero|quiero) (?:\w+ ){0,2}(?:declinar|rechazar|abstenerme)|no (?:me está|se me|estoy|tengo) (?:permit\w+|autorizad\w+|permiso)|preferir?[íi]?[oa]? no\b",
        r"no (?:puedo|podría|debo|voy a|quiero|me es posible)|incapaz de|imposible",
        r"ayudar\w*|responder|contestar|clasificar|dar|emitir|proporcionar|asignar|etiquetar|atender|decidir|juzgar|evaluar|elegir|hacer",
    ),
    "it": (
        r"mi dispiace|(?:devo|preferisco|voglio) (?:\w+ ){0,2}(?:rifiutare|declinare|astenermi)|non (?:mi è|sono) (?:permesso|consentito|autorizzat\w+|in grado)|preferi(?:rei|sco) non",
        r"non (?:posso|potrei|voglio|intendo)",
        r"aiutar\w*|rispondere|classificare|dare|fornire|esprimer\w*|decidere|giudicare|valutare|scegliere|fare",
    ),
    "pt": (
        r"(?:lamento|desculpe|sinto muito),? mas|(?:devo|tenho de|tenho que|prefiro) (?:\w+ ){0,2}(?:recusar|declinar)|não (?:me é|estou) (?:permitido|autorizad\w+)|prefiro não|preferia não",
        r"não (?:posso|poderia|devo|vou|quero|consigo)",
        r"ajudar|responder|classificar|dar|fornecer|decidir|julgar|avaliar|escolher|fazer",
    ),
    "nl": (
        r"het spijt me|(?:moet|wil) (?:\w+ ){0,3}(?:weigeren|afzien)|niet (?:toegestaan|bevoegd|gemachtigd)|liever niet",
        r"(?:kan|mag|wil|zal)(?: ik)?(?: \w+){0,3}? (?:niet|geen)",
        r"helpen|beantwoorden|antwoorden|beoordelen|beslissen|geven|maken|classificeren|indelen|doen",
    ),
    "nordic": (
        r"(?:jeg )?beklager|(?:jag )?beklagar|jag är ledsen|desværre,? (?:men )?(?:jeg )?kan|(?:må|måste) (?:\w+ ){0,2}(?:avslå|avböja|afvise)|(?:vill|vil) helst (?:inte|ikke)|helst (?:inte|ikke)|pahoittelen|valitettavasti en voi",
        r"(?:kan|får|må|vil|vill|kommer)(?: \w+){0,2}? (?:ikke|inte|ej)|en voi",
        r"hjelpe|hjälpa|hjælpe|svare|svara|klassifi\w+|bedøm\w*|bedöm\w*|vurdere|avgjøre|avgöra|afgøre|gi|ge|give|velge|välja|vælge|auttaa|vastata",
    ),
    "slavic": (
        r"przykro mi|(?:muszę|wolę|wolałbym|wolałabym) (?:\w+ ){0,2}(?:odmówić|nie)|nie wolno mi|к сожалению|извините,? но|прошу прощения|вынужден\w* отказать\w*|мне не (?:разрешено|позволено)|(?:предпочитаю|предпочел\w*|предпочла) не|omlouvám se|bohužel",
        r"nie (?:mogę|mogłabym|mógłbym|będę|potrafię)|не (?:могу|буду|вправе|имею права|в состоянии)|nemohu|nemůžu",
        r"pomóc|odpowiedzieć|ocenić|udzielić|klasyfikować|sklasyfikować|wybrać|zdecydować|podać|помочь|ответить|отвечать|оценить|дать|давать|классифицировать|выбрать|решать|решить|pomoci|odpovědět",
    ),
    "other": (
        r"申し訳|お答えできません|お答えすることはできません|回答できません|回答を控え|お断り|判断できません|できかねます|いたしかねます|お手伝いできません|抱歉|对不起|對不起|无法(?:回答|提供|帮助|判断|分类)|無法(?:回答|提供|幫助|判斷|分類)|不能(?:回答|提供|帮助)|죄송|도와드릴 수 없|답변할 수 없|답변드릴 수 없|آسف|عذرا|لا أستطيع|لا يمكنني|üzgünüm|yardımcı olamam|yanıtlayamam|îmi pare rău|nu pot (?:ajuta|răspunde)|sajnálom|nem tudok (?:segíteni|válaszolni)",
        None,
        None,
    ),
}
_EDGE, _END = r"(?:^|[^\pL\pN])", r"(?:$|[^\pL\pN])"


#: One automaton per language and kind: together they would outgrow the memory that such automata get.
REFUSALS = [f"(?s){'' if code == 'other' else _EDGE}(?:{alone})" for code, (alone, _, _) in _REFUSING.items()]
REFUSALS += [f"(?s){_EDGE}(?:{negation})(?: [\\pL'’-]+){{0,4}}? (?:{verbs}){_END}" for _, negation, verbs in _REFUSING.values() if verbs]
#: The same at the beginning: only a greeting or an apology may come before it.
OPENINGS = [x.replace("(?s)", r'(?s)^[^\pL\pN{"]*(?:[\pL\']+[ ,;!]+){0,5}?(?:[\pL\']+)?', 1) for x in REFUSALS]

#: The commonest function words of languages written in Latin or Cyrillic letters.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their if will each about how up out them then many some so these would other into has more her two him see could no than been who its now did get may while another although though because only very just most such near around enough here nothing same",
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine dem im es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man dann da sein wenn ich auch kann diese dieser einen als was keine etwa während obwohl kaum deshalb gut wir sehr hier viel weniger",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la mais comme ou si leur y dont aux avec cette ces être fait tout nous sa elle deux même bien sans peu donc rien très tandis autour pendant presque ainsi je assez alors moins encore après avant autres",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada mientras aunque nada casi menos mucho otra demás cerca torno",
    "it": "di e il la che in un a per è una sono con non del si da i le dei al come lo alla ha più dell delle nel o anche ma della gli della questo ci se loro sua suo nella essere ed dal molto quasi mentre quindi tutto questa dove quando due così senza poco meno fra sul dalla ancora sembra altri altre fino ogni",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem suas meu às minha têm enquanto embora quase nada menos outros toda cerca",
    "nl": "de het een van en in is dat op te zijn met voor niet die aan er om ook als dan maar bij uit nog door naar heeft worden wordt over werd hij ze kan geen deze meer was of tot je al zich hun dit veel wel moet zo ik tegen na waar onder terwijl hoewel dus andere verder niets rond ongeveer bijna",
    "pl": "i w na z się nie do że jest to o jak po a co ale od za przez dla są już tak tylko czy jego ich być przy oraz może które który która tym tego jej był było można bardzo gdy też ze więc lub jednak choć podczas prawie około inne mniej więcej nic ten ta",
    "ru": "и в не на я что он с как это по но они мы все она так его за был от же к у из для ее её то бы вы о до если или уже при только еще ещё их есть мне был была были когда где очень без может чем кто нет под также этот эта около почти хотя поэтому во время другие более менее ничего",
    "sv": "och i att det som en på är av för med den till inte har de ett om han men var sig från så vi kan när hon eller nu också under vara efter bara där ut över mycket medan dock inget nästan andra mindre mer denna",
    "no": "og i det er på til som en å for at med av ikke den har de han et om var fra så vi kan når hun eller nå også være etter bare der ut over mye mens men ingenting nesten andre mindre mer denne seg rundt",
    "da": "og i det er på til som en at for med af ikke den har de han et om var fra så vi kan når hun eller nu også være efter kun der ud over meget mens men intet næsten andre mindre mere denne sig omkring",
    "fi": "ja on ei se että oli hän joka mutta kun niin myös kuin tai ovat sen ole vain jo nyt jos sitä sekä mukaan noin vielä kanssa lähes muut vähän",
    "cs": "a se v na je že to s z do o i jako za by ale pro jsou po k ve od jeho nebo tak podle byl být které který jen není při však až už jsem více mezi téměř ostatní kolem méně",
    "ro": "și de în la cu a pe o nu un să care din este mai pentru ca ce că sau sunt după prin fost fi dar au lui dintre când foarte aproape între în timp ce alte",
    "hu": "a az és hogy nem is egy ez van de csak meg már ha mint vagy volt azt el még ki majd mert nagyon minden lehet közel míg alatt szinte többi",
    "tr": "ve bir bu da de için ile çok daha olarak gibi en kadar olan sonra ne var o ya ama mi değil her ise ancak göre yakın neredeyse diğer sırasında",
}
_CODES = tuple(FUNCTION_WORDS)
_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai")

_BEYOND = r"[\x{0370}-\x{1DFF}\x{2C00}-\x{FAFF}\x{10000}-\x{10FFFF}]"  # letters of other scripts than Latin
_BLANK = r"\s\x{00A0}\x{00AD}\x{0085}\x{200B}-\x{200F}\x{2028}-\x{202F}\x{2060}-\x{2064}\x{3000}\x{FEFF}"
_MARKS = rf"[{_BLANK}\pP\pS\pZ\pC]"
_SHELL = rf'^[{_BLANK}]*\{{\s*(?:"\w+"\s*:\s*(?:null|"\s*"|\[\s*\]|\{{\s*\}})\s*,?\s*|"confidence"\s*:\s*0(?:\.0*)?\s*,?\s*)*\}}[{_BLANK}]*$'
_RE2_LABEL = r"(?i)\blabel\"?\s*[:=]\s*\"?\s*(?:-?\d+|" + "|".join(CLASSES) + r")(?:[^\pL\pN_]|$)"
_FIELDS = r"label|confidence|sicherheit|konfidenz|confiance|confianza|confidenza|confiança|zekerheid"
_PIECE = 24


def has_label(response: Column) -> Column:
    return F.coalesce(response.rlike(LABEL), F.lit(False))


def _find(a: pa.Array, pattern: str) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(a, pattern), False).to_numpy(zero_copy_only=False)


def _count(a: pa.Array, what: str) -> np.ndarray:
    return pc.fill_null(pc.count_substring(a, what), 0).to_numpy()


def _letters(a: pa.Array, kind: str) -> np.ndarray:
    return pc.fill_null(pc.count_substring_regex(a, rf"\p{{{kind}}}"), 0).to_numpy()


def empty_rows(lower: pa.Array) -> np.ndarray:
    bare = pc.replace_substring_regex(lower, r"```(?:[ \t]*\w+)?", " ") if pc.any(pc.match_substring(lower, "```")).as_py() else lower
    names = "|".join(PLACEHOLDERS)
    return pc.is_null(lower).to_numpy(zero_copy_only=False) | _find(bare, rf"^{_MARKS}*$") | _find(bare, rf"^{_MARKS}*(?:{names}){_MARKS}*$") | _find(bare, _SHELL)


_NOT_WORD = bytes(c for c in range(128) if not chr(c).isalnum())
_NOT_LETTER = bytes(c for c in range(128) if not chr(c).isalpha() and chr(c) not in " \n")
_ALPHA = np.array([chr(c).isalpha() for c in range(128)] + [True] * 128)


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a column without NULLs."""
    a = pa.concat_arrays([a])
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _letter_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters: of ASCII the letters, of the rest all but the blocks of punctuation."""
    keep = _ALPHA[data]
    lead = np.flatnonzero(data >= 0xC2)
    lead = lead[lead + 1 < len(data)]
    byte, second = data[lead], data[lead + 1]
    two = lead[byte == 0xC2]
    three = lead[((byte == 0xE2) & (second <= 0x81)) | ((byte == 0xE3) & (second == 0x80))]
    for k in (0, 1):
        keep[two + k] = False
    for k in (0, 1, 2):
        keep[three + k] = False
    return keep


def _bare(a: pa.Array, drop: bytes) -> list[bytes]:
    return [x.translate(None, drop) for x in a.cast(pa.binary()).to_pylist()]


def copied_rows(prompt: pa.Array, response: pa.Array, share: float = 0.5, least: int = 3, large: int = 8) -> np.ndarray:
    """Where pieces of the response, one after the other, lie in the prompt; both in small letters."""
    out = np.zeros(len(prompt), bool)
    for i, (p, r) in enumerate(zip(_bare(prompt, _NOT_WORD), _bare(response, _NOT_WORD))):
        if p and len(r) >= least * _PIECE:
            pieces = len(r) // _PIECE
            hits = sum(r[k : k + _PIECE] in p for k in range(0, pieces * _PIECE, _PIECE))
            out[i] = hits >= large or (hits >= least and hits >= share * pieces)
    return out


def truncated_rows(response: pa.Array) -> np.ndarray:
    """Unclosed delimiters, or an end within a sentence or a number."""
    text = pc.utf8_rtrim_whitespace(response)
    quotes = _count(pc.replace_substring_regex(text, r"\\.", "") if pc.any(pc.match_substring(text, "\\")).as_py() else text, '"')
    unclosed = (_count(text, "{") > _count(text, "}")) | (_count(text, "[") > _count(text, "]")) | (_count(text, "```") % 2 == 1) | (quotes % 2 == 1)
    # languages that write without blanks end their sentences as they like
    abrupt = _find(text, r"(?:\p{Latin}|\p{Cyrillic}|\p{Greek}|[,;:(\-])$") & ~_find(text, _RE2_LABEL + r"$|^\s*(?:[\pL'’-]+ ?){1,2}$")
    number = _find(text, r"\d$") & ~_find(text, rf'(?i)(?:{_FIELDS})"?\s*[:,=]?\s*[\d.]+$|label\W{{1,4}}\d+\W{{1,3}}[\d.]+$|^[^.!?]{{0,40}}$')
    return unclosed | abrupt | number


def wording(lower: pa.Array) -> pa.Array:
    """What of an answer has a language: no JSON keys, class names or bracketed remarks."""
    return pc.replace_substring_regex(lower, r'"\w+"\s*:|\([^)]*\)|' + "|".join([*CLASSES, "label", "json", "null", "confidence"]), " ")


def _vocabulary() -> tuple[pa.Array, np.ndarray]:
    """All function words, and for each the languages that have it."""
    words = sorted({w for ws in FUNCTION_WORDS.values() for w in ws.split()})
    sets = [set(ws.split()) for ws in FUNCTION_WORDS.values()]
    return pa.array(words), np.array([[w in s for s in sets] for w in words], np.int32)


_WORDS, _SPEAKS = _vocabulary()


def language_hits(lower: pa.Array) -> np.ndarray:
    """[row, language]: the number of different function words of each language in each text."""
    data, offsets = _bytes(pc.fill_null(lower, ""))
    letter = _letter_bytes(data)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] |= letter[offsets[:-1][offsets[:-1] < len(data)]]  # texts follow one another without a gap
    starts = np.flatnonzero(first)
    row = np.searchsorted(offsets, starts, "right") - 1
    kept = data[letter]
    cuts = np.r_[np.cumsum(letter)[starts] - 1, len(kept)].astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(kept)])
    at = pc.index_in(words, _WORDS)
    known = pc.is_valid(at).to_numpy(zero_copy_only=False)
    pairs = np.unique(row[known].astype(np.int64) * len(_WORDS) + at.drop_null().to_numpy())
    out = np.zeros((len(lower), len(_CODES)), np.int64)
    if len(pairs):
        rows, words = np.divmod(pairs, len(_WORDS))
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[starts]] = np.add.reduceat(_SPEAKS[words], starts, axis=0)
    return out


def repeated_hits(lower: pa.Array) -> np.ndarray:
    """language_hits of texts that repeat one another but for numbers and marks: each wording is looked up once."""
    code = pa.array(_bare(lower, _NOT_LETTER), pa.binary()).dictionary_encode()
    where = code.indices.to_numpy()
    one = np.zeros(len(code.dictionary), np.int64)
    one[where] = np.arange(len(where))
    return language_hits(lower.take(pa.array(one)))[where]


def scripts(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(commonest script, letters of it) of each text; -1 without letters."""
    counts = np.stack([_letters(a, s) for s in _SCRIPTS], axis=1)
    counts[:, 6] += counts[:, 7] + counts[:, 8]  # Japanese mixes three
    counts[:, 7:9] = 0
    return np.where(counts.any(axis=1), counts.argmax(axis=1), -1), counts.max(axis=1)


def foreign_rows(prompt: pa.Array, response: pa.Array, least: int = 2) -> np.ndarray:
    """Where the response is worded in another script or language than the prompt; both in small letters."""
    said = wording(response)
    asked, answered = repeated_hits(prompt), language_hits(said)
    rows = np.arange(len(asked))
    mine = asked.argmax(axis=1)
    clear = asked[rows, mine] >= least
    best = answered.max(axis=1)
    foreign = clear & (best >= least) & (best >= answered[rows, mine] + 2)
    odd = np.flatnonzero(_find(said, _BEYOND) | _find(prompt, _BEYOND))
    if len(odd):
        at = pa.array(odd)
        (p, np_), (r, nr) = scripts(prompt.take(at)), scripts(said.take(at))
        foreign[odd] |= (p >= 0) & (r >= 0) & (p != r) & (np_ > 0) & (nr >= np.where(r == 0, 12, 4))
    return foreign


def judge(prompt: pa.Array, response: pa.Array) -> np.ndarray:
    """[row, defect type]: every rule that a batch of pairs triggers."""
    p, r = pc.fill_null(pc.utf8_lower(prompt), ""), pc.utf8_lower(response)
    out = np.zeros((len(p), len(DEFECTS)), bool)
    out[:, 0] = empty_rows(r)
    at = np.flatnonzero(~out[:, 0])
    if not len(at):
        return out
    live = pa.array(at)
    p, r, raw = p.take(live), r.take(live), response.take(live)
    label = _find(raw, _RE2_LABEL)
    copy = copied_rows(p, r)
    spoken = pc.replace_substring(r, "’", "'") if pc.any(pc.match_substring(r, "’")).as_py() else r
    refusal = np.logical_or.reduce([_find(spoken, x) for x in REFUSALS])
    if (refusal & label).any():
        both = np.flatnonzero(refusal & label)
        some = spoken.take(pa.array(both))
        refusal[both] = np.logical_or.reduce([_find(some, x) for x in OPENINGS])
    asks = _find(p, r"(?:^|[^\pL])label(?:[^\pL]|$)")
    out[at, 1], out[at, 2] = copy, refusal & ~copy
    out[at, 3] = truncated_rows(raw) | (asks & ~(label | copy | refusal))
    out[at, 4] = foreign_rows(p, r)
    return out


def main_defects(flagged: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, defect) of each defective pair with its first defect."""
    return flagged.where("defect is not null").select(*keep, "defect")


def flag_pairs(df: DataFrame, prompt: str = "prompt", response: str = "response") -> DataFrame:
    """df with `defects` ARRAY<STRING> (every triggered type in the order of the rules) and `defect`, the first or NULL."""
    kept: Sequence[T.StructField] = [f for f in df.schema.fields if f.name.lower() not in ("defects", "defect")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("defects", T.ArrayType(T.StringType())), T.StructField("defect", T.StringType())])
    types = pa.array(DEFECTS)

    def run(batches):
        for batch in batches:
            found = judge(batch.column(prompt).cast(pa.string()), batch.column(response).cast(pa.string()))
            row, kind = np.nonzero(found)
            offsets = np.r_[0, np.cumsum(found.sum(axis=1))].astype(np.int32)
            first = pa.array(found.argmax(axis=1), mask=~found.any(axis=1))
            more = [pa.ListArray.from_arrays(pa.array(offsets), types.take(pa.array(kind, pa.int64()))), types.take(first)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *more], [*names, "defects", "defect"])

    return df.select(*names).mapInArrow(run, schema)
