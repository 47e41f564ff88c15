"""Personal information in free text: typed spans and placeholders (problem 4).

Method: regular expressions propose spans with a base score, checksum validators (Luhn, mod-97,
the national check letters and digits) confirm them, words near the span raise or lower the score, and spans
above the threshold win, the higher score first where two overlap.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMAIL, PHONE, ID, ADDRESS, NAME = "email", "phone", "id_number", "street_address", "person_name"
PLACEHOLDER = {EMAIL: "[EMAIL]", PHONE: "[PHONE]", ID: "[ID_NUMBER]", ADDRESS: "[STREET_ADDRESS]", NAME: "[PERSON_NAME]"}
THRESHOLD = 0.5
NEAR = 40  # characters of context on either side

_AT = r"(?:@|＠|\s?\(\s?(?:at|AT|@|arroba|chiocciola)\s?\)\s?|\s?\[\s?(?:at|AT|@)\s?\]\s?|\s?\{\s?at\s?\}\s?|\s(?:AT|at)\s)"
_DOT = r"(?:\.|．|\s?\(\s?(?:dot|DOT|punkt|point|punto)\s?\)\s?|\s?\[\s?(?:dot|DOT|punkt|point|punto)\s?\]\s?|\s(?:DOT|dot|punkt|point|punto)\s)"
_LABEL = r"[^\W_](?:[\w-]{0,61}[^\W_])?"
EMAIL_RE = re.compile(rf"(?<![\w.+%/-])(?:mailto:)?[^\W_](?:[\w.+%'-]{{0,62}}[^\W_])?{_AT}{_LABEL}(?:{_DOT}{_LABEL}){{0,4}}{_DOT}[^\W\d_]{{2,24}}(?![\w@-])")
DIGIT = re.compile(r"\d")
PLAIN_AT = re.compile(r"@|＠")
CAPITALS = re.compile(r"[A-Z]{2,}")

# Proposed telephone shapes and how sure each is by itself.
_S = r"[ \u00a0\u202f\u2009.\-‐‑–/]"
PHONES = [
    (re.compile(rf"(?<![\w+./-])(?:\+|00)[1-9]\d{{0,3}}(?:{_S}?\(0?\d{{0,4}}\))?(?:{_S}?\d{{1,8}}){{1,6}}(?![\w-]|[.,/]\d)"), 0.7),
    (re.compile(rf"(?<![\w+./-])(?:1{_S})?\(\d{{3}}\){_S}?\d{{3}}{_S}\d{{4}}(?:\s?(?:ext\.?|x)\s?\d{{1,5}})?(?![\w-])"), 0.7),
    (re.compile(rf"(?<![\w+./-])(?:1{_S})?[2-9]\d{{2}}({_S})[2-9]\d{{2}}\1\d{{4}}(?:\s?(?:ext\.?|x)\s?\d{{1,5}})?(?![\w-]|[.,/]\d)"), 0.6),
    (re.compile(r"(?<![\w+./-])0[1-9](?:[ \u00a0.]\d{2}){4}(?![\w-]|[.,/]\d)"), 0.6),
    (re.compile(r"(?<![\w+./-])\(?0\d{2,5}\)?(?:[ \u00a0/]|[ ]?/[ ]?)\d{3,5}(?:[ \u00a0-]\d{2,5}){0,3}(?![\w-]|[.,/]\d)"), 0.55),
    (re.compile(r"(?<![\w+./-])\(?0\d{2,5}\)?[ \u00a0/\-‐‑–]\d{5,8}(?![\w-]|[.,/]\d)"), 0.35),
    (re.compile(r"(?<![\w+./-])0\d{9,10}(?![\w-]|[.,/]\d)"), 0.35),
    (re.compile(r"(?<![\w+./-])[5-9]\d{2}[ \u00a0-]\d{3}[ \u00a0-]\d{3}(?![\w-]|[.,/]\d)"), 0.35),
    (re.compile(r"(?<![\w+./-])8[ -]\(?\d{3}\)?[ -]\d{3}[ -]\d{2}[ -]\d{2}(?![\w-])"), 0.6),
]
PHONE_WORDS = re.compile(
    r"\b(?:phone|telephone|tel|mobile|cell|call|ring|fax|sms|text|whatsapp|message at|number is|reach|dial|hotline|ext"
    r"|telefon\w*|handy|mobil\w*|rückruf|anruf\w*|tél(?:éphone)?|portable|appel\w*|rappel\w*|móvil|teléfono|llam\w+|telefono|cellulare|chiam\w+"
    r"|telefone|telemóvel|lig(?:ar|ue)|telefoon|mobiel|bellen|komórka|zadzwo\w+|тел|телефон\w*|звон\w+|моб)\b", re.I)
THING_WORDS = re.compile(
    r"\b(?:invoice|order|item|part|serial|sn|isbn|issn|ean|sku|batch|lot|build|version|ref|reference|count|pieces|ticket|tracking|parcel no"
    r"|artikel\w*|rechnung\w*|bestell\w*|serien\w*|facture|commande|série|factura|pedido|serie|fattura|ordine|fatura|encomenda|factuur|bestelling"
    r"|faktura|zamówieni\w+|счёт|заказ|grid|page|chapter|box|shelf|reading|width|size|pump|model|copy|log)\b", re.I)

# Identity numbers: the word that names the document, then the number; the validator confirms where one is defined.
_NO = r"(?:\s?(?:no|number|nr|num|n[°ºo]|номер|№|numer|número|numéro|numero|nummer|card|id|identity card)\b\.?)?\s?[:#.]?\s?"
IDS = [
    (re.compile(rf"\b(?:SSN|S\.S\.N\.|social security|soc\.? sec\.?|SVNR|Sozialversicherungs\w*|sécurité sociale|seguridad social)\b{_NO}(\d{{3}}[ \u00a0-]?\d{{2}}[ \u00a0-]?\d{{4}}|\d[\d \u00a0-]{{8,20}}\d)(?![\w-])", re.I), 0.8),
    (re.compile(rf"\b(?:NI|N\.I\.|NINO|national insurance){_NO}([A-Z]{{2}}\s?\d{{2}}\s?\d{{2}}\s?\d{{2}}\s?[A-D])\b", re.I), 0.9),
    (re.compile(rf"\b(?:passport|Reisepass|Pass|passeport|pasaporte|passaporto|passaporte|paspoort|paszport|паспорт\w*){_NO}([A-Z]{{0,3}}\s?\d[\dA-Z]*(?:[ \u00a0-]?\d+){{0,4}})\b", re.I), 0.8),
    (re.compile(rf"\b(?:Personalausweis\w*|Ausweis\w*|identity card|ID card|identity no|carte d['’]identité|carta d['’]identità|identiteitskaart|dowód(?: osobisty)?|cédula|cartão de cidadão|bilhete de identidade|удостоверени\w+){_NO}([A-Z0-9]{{1,4}}\s?\d[\dA-Z]*(?:[ \u00a0-]?[\dA-Z]*\d[\dA-Z]*){{0,4}})\b"), 0.8),
    (re.compile(rf"\b(?:DNI|NIF|NIE|D\.N\.I\.){_NO}([XYZ]?[ -]?\d{{1,2}}\.?\d{{3}}\.?\d{{3}}[ -]?[A-Z]?)(?![\w-])", re.I), 0.8),
    (re.compile(rf"\b(?:tax (?:ID|number|no|ref\w*)|TIN|taxpayer|Steuer-?(?:ID|nummer|nr)\w*|IdNr|numéro fiscal|NIF|codice fiscale|contribuinte|BSN|burgerservicenummer|PESEL|NIP|ИНН|СНИЛС){_NO}([A-Z0-9]*\d[\dA-Z]*(?:[ \u00a0/.-]?[\dA-Z]*\d[\dA-Z]*){{0,5}})\b", re.I), 0.8),
    (re.compile(rf"\b(?:driv(?:ing|er['’]?s?) licen[cs]e|licen[cs]e (?:no|number)|Führerschein\w*|permis de conduire|permiso de conducir|carnet de conducir|patente(?: di guida)?|carta de condução|rijbewijs|prawo jazdy|водительск\w+){_NO}([A-Z0-9]*\d[\dA-Z]*(?:[ \u00a0-]?[\dA-Z]*\d[\dA-Z]*){{0,4}})\b", re.I), 0.8),
    (re.compile(r"(?<![\w-])(\d{8}-?[A-Z])(?![\w-])"), 0.2),
    (re.compile(r"(?<![\w-])([A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?![\w-])"), 0.45),
    (re.compile(r"(?<![\w.-])([A-Z]{6}\d{2}[A-EHLMPR-T]\d{2}[A-Z]\d{3}[A-Z])(?![\w-])"), 0.3),
    (re.compile(r"(?<![\w.+/-])(\d{11})(?![\w-]|[.,/]\d)"), 0.1),
    (re.compile(r"(?<![\w.+/-])([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![\w-])"), 0.1),
    (re.compile(r"(?<![\w.+/-])((?:\d[ -]?){12,18}\d)(?![\w-]|[.,/]\d)"), 0.0),
]
ID_WORDS = re.compile(r"\b(?:permit|form|file|booked|copy|renew|valid|identity|ausweis|passport|licen[cs]e|tax|social|SSN|IBAN|account|konto|card|karte)\b", re.I)

# Kinds of streets, before and after the name.
_AFTER = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Crescent|Cres\.?|Close|Court|Ct\.?|Drive|Dr\.?|Way|Place|Pl\.?|Square|Sq\.?|Terrace|Row|Walk|Hill|Boulevard|Blvd\.?|Gardens|Mews|Parade|Quay|Wharf|Highway)"
_BEFORE = r"(?:[Rr]ue|[Aa]venue|[Bb]oulevard|bd\.?|[Pp]lace|[Ii]mpasse|[Aa]llée|[Cc]hemin|[Qq]uai|[Rr]oute|[Cc]alle|c/|[Aa]venida|[Aa]vda\.?|[Pp]laza|[Pp]aseo|[Cc]amino|[Tt]ravesía|[Vv]ia|[Vv]iale|[Pp]iazza|[Cc]orso|[Vv]icolo|[Ll]argo|[Rr]ua|[Tt]ravessa|[Pp]raça|[Ee]strada|[Aa]lameda|ul\.?|ulica|al\.?|aleja|plac|os\.?|ул\.?|улица|пр\.?|проспект|пер\.?|переулок|наб\.?|набережная|площадь)"
_W = r"[^\W\d_][\w'’.-]*"
_C = r"(?:(?![a-zß-öø-ÿа-яё])[^\W\d_][\w'’-]*)"
_NUM = r"\d{1,4}(?:[ ]?[a-dA-D](?!\w))?(?:[-/]\d{1,4})?"
_UNIT = r"(?:[Aa]pt|[Ff]lat|[Uu]nit|[Aa]partment|[Ss]uite|app|appt|piso|int|interno|scala|kv|кв|lok)\.?"
_FLOOR = r"(?:,?[ ]?\d{1,2}[ ]?\.?[ ]?[ºª°](?:[ ]?[A-Z](?!\w))?)"
_TAIL = rf"(?:,[ ]?{_UNIT}[ ]?\w{{1,5}}(?!\w))?{_FLOOR}?(?:,?[ ](?:\d{{4,6}}|\d{{2}}-\d{{3}}|\d{{4}}-\d{{3}}|\d{{4}}[ ]?[A-Z]{{2}})[ ]{_C}|,[ ]{_C}(?:[ ]{_C})?[ ][A-Z]{{1,2}}\d[A-Z\d]?[ ]?\d[A-Z]{{2}})?"
ADDRESSES = [
    (re.compile(rf"(?:(?<!\w){_UNIT}[ ]?\w{{1,5}},[ ])?(?<![\w.,-]){_NUM}[ ](?:{_C}[ ]){{1,3}}{_AFTER}(?!\w){_TAIL}"), 0.7),
    (re.compile(rf"(?:(?<!\w){_UNIT}[ ]?\w{{1,5}},[ ])?(?<![\w.,-])\d{{1,4}}[ ](?:[^\W\d_]+[ ]){{1,2}}(?:street|st\.|road|rd\.?|lane|avenue|ave\.?|crescent|close|drive|square|terrace|boulevard|blvd\.?)(?!\w){_TAIL}"), 0.6),
    (re.compile(rf"(?<![\w.,-]){_NUM},?[ ](?:bis[ ]|ter[ ])?{_BEFORE}[ ](?:(?:de|du|des|la|le|les|l['’]|d['’])[ ]?){{0,3}}{_W}(?:[ -]{_C}){{0,3}}{_TAIL}"), 0.7),
    (re.compile(rf"(?<!\w){_BEFORE}[ ](?:(?:de|del|della|delle|dei|degli|dell['’]|do|da|dos|das|la|las|los|el)[ ]?){{0,3}}{_C}(?:[ -]{_C}){{0,3}},?[ ](?:n[.º°]?[ ]?|nº[ ]?|д\.[ ]?|дом[ ])?{_NUM}(?![\w%]|[.,]\d){_TAIL}"), 0.65),
    (re.compile(rf"(?<!\w)(?:(?:Am|An der|An den|Auf dem|Auf der|Im|In der|Zum|Zur)[ ])?[^\W\d_][\w-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|steig|straat|laan|gracht|kade|plein|dijk|singel|steeg)[ ]{_NUM}(?![\w%]|[.,]\d){_TAIL}"), 0.65),
    (re.compile(rf"(?<!\w)(?:Am|An der|An den|Auf dem|Auf der|Zum|Zur|Unter den|Hinter der)[ ]{_C}(?:[ ](?:Straße|Weg|Platz|Allee|Gasse))?[ ]\d{{1,3}}[a-d]?(?![\w%]|[.,]\d|[ ](?:Uhr|Minuten|Prozent|cm|mm|kg|Stück)){_TAIL}"), 0.5),
]
# Words without which a rule of ADDRESSES, by its place, can't match.
_KINDS = set("street st road rd lane ln avenue ave crescent cres close court ct drive dr way place pl square sq terrace row walk hill boulevard blvd gardens mews parade quay wharf highway".split())
_FIRST = set(
    "rue avenue av boulevard bd place impasse allée chemin quai route calle c avenida avda plaza paseo camino travesía via viale piazza corso vicolo largo rua travessa praça estrada alameda "
    "ul ulica al aleja plac os ул улица пр проспект пер переулок наб набережная площадь".split())
_ENDS = ("straße", "strasse", "str", "gasse", "weg", "platz", "allee", "ufer", "damm", "steig", "straat", "laan", "gracht", "kade", "plein", "dijk", "singel", "steeg")
_LEADS = set("am an auf zum zur unter hinter".split())
GATES = (
    lambda w: not w.isdisjoint(_KINDS), lambda w: not w.isdisjoint(_KINDS), lambda w: not w.isdisjoint(_FIRST), lambda w: not w.isdisjoint(_FIRST),
    lambda w: any(x.endswith(_ENDS) for x in w), lambda w: not w.isdisjoint(_LEADS),
)
FIVE = re.compile(r"\d(?:\D*\d){4}")  # an identity number has five digits, with letters or signs between them
SEVEN = re.compile(r"\d(?:[^\w\n]{0,4}\d){6}")  # a telephone number seven


# Titles, given names of the nine languages, and words that announce or follow a person.
TITLES = r"(?:Dr|Mr|Mrs|Ms|Miss|Mx|Prof|Professor|Sir|Dame|Herr|Frau|Herrn|M|Mme|Mlle|Monsieur|Madame|Sr|Sra|Srta|Señor|Señora|Don|Doña|Sig|Sigra|Signor|Signora|Dott|Dottssa|Senhor|Senhora|Dhr|Mevr|Mevrouw|Meneer|Pan|Pani|Г-н|Г-жа)"
GIVEN = set(
    "Ada Adrian Agata Agnes Aleksander Alice Amadeo Amelie Ana Anders Andrea Andrew Anika Anna Anne Anton Antonio Arthur Astrid Barbara Bartek Bastian Beatrice "
    "Benedikt Bernard Bianca Birgit Birte Bruno Camille Carla Carlos Cecilia Celine Charlotte Chiara Claire Clara Cosimo Daniel Darek David Diego Dmitri Dorothea Edda Edgar "
    "Elena Elisa Elske Emil Emma Enrico Erik Esther Eva Fabian Felix Fernando Filip Fiora Francesca Franz Freya Gabriel George Georg Giulia Greta Gustav Hanna Hannah Hans "
    "Heidi Helena Henri Henrike Henry Hugo Ida Ilse Imre Inga Ines Ingrid Isabel Ivan Jakub Jana Jannik Jan Javier Jeanne Joana Johan Johanna John Jonas Joran Jorge Josef Julia "
    "Jules Karin Karl Katarzyna Klara Konrad Lara Laura Lena Leon Leonie Leontine Lina Lorenzo Louis Lucan Lucia Lucas Ludwig Luis Luisa Maelle Magda Marek Maria Marie Marta Martin Mateusz "
    "Mathilde Matteo Mila Mira Natalia Nadia Nico Nina Noor Nora Odile Olaf Olga Oriane Oscar Otto Pablo Paul Paula Pavel Pedro Petra Philippe Pierre Piotr Renata Renzo Ricardo Robert Rosa Rufus Saskia Sergei Silvia "
    "Simon Sofia Solveig Stefan Susanne Svetlana Tamsin Teresa Thomas Tobias Tobin Tomasz Ulla Ulrich Ursula Vera Victor Viggo Vincent Wanda Werner William Xavier Yara Ysolde Yves Zofia".split()
)
_UP = r"[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĶĹĻŁŃŅŇŌŐŒŔŘŚŞŠŤŪŮŰŹŻŽА-ЯЁ]"
_LO = r"[a-zß-öø-ÿāăąćčďđēęěğģīķĺļłńņňōőœŕřśşšťūůűźżžа-яё]"
_N = rf"{_UP}(?:{_LO}+(?:[-'’]{_UP}?{_LO}+)*|['’]{_UP}{_LO}+)"
_B = "[ \u00a0\u202f]"
_FAMILY = rf"(?:(?:van der|van den|van de|van|von der|von|de la|de|del|della|di|da|dos|du|zu|ter|ten){_B})?{_N}"
_NAME = rf"(?:{_N}{_B}(?:{_N}{_B}|{_UP}\.{_B}){{0,2}}{_FAMILY}|(?:{_UP}\.{_B}?){{1,2}}{_FAMILY}|{_N},{_B}{_N})"
# Phrases right before a person, and words right after one; a bar parts the phrases.
BEFORE_PERSON = (
    "spoke with|spoke to|thanks to|birthday of|borrowed by|lent to|returned by|signed by|signed|letter to|letter from|meeting with|met with|call from|call|note from|mail from|message from"
    "|over to|attn|dear|written by|reported by|rückgabe an|danke an|gespräch mit|geburtstag von|ausgeliehen von|gez.|merci à|rendez-vous avec|gracias a|reunión con|grazie a|incontro con"
    "|obrigado a|reunião com|dank aan|afspraak met|spotkanie z|спасибо|встреча с|owner:|author:|contact:"
)
ASKED = (
    "ask|asked|tell|told|phone|phoned|ring|rang|email|emailed|contact|thank|thanked|visit|visited|invite|invited|remind|frag|frage|fragt|sag|ruf|demander à|demandez à|appeler|pregunta a|llama a|chiedi a|chiama"
    "|pergunte a|liga a|vraag|bel|zapytaj|спроси|позвони"
)
AFTER_PERSON = "wants?|is on the|called|asked|said|wrote|says|signed|left|will|möchte|hat|sagt|until|re|–"
ACTED = (
    "called|asked|said|says|wrote|told|phoned|rang|brought|borrowed|returned|promised|agreed|offered|lent|thinks|thought|explained|suggested|complained|apologised|apologized|reminded|invited|arrived|answered|replied"
    "|sagte|sagt|fragte|brachte|rief|schrieb|meinte|a dit|a demandé|a appelé|a apporté|dijo|preguntó|llamó|trajo|ha detto|ha chiesto|ha chiamato|ha portato|disse|perguntou|ligou|trouxe|zei|vroeg|belde|bracht"
    "|powiedział|powiedziała|zapytał|zapytała|zadzwonił|zadzwoniła|сказал|сказала|спросил|спросила|позвонил|позвонила|принёс|принесла"
)


def _phrases(listed: str) -> str:
    return "|".join(re.escape(p).replace(r"\ ", " ").replace("s\\?", "s?") for p in listed.split("|"))


STRONG_CUE = re.compile(rf"(?<!\w)(?:{_phrases(BEFORE_PERSON)}):?\s+$", re.I)
ASK_CUE = re.compile(rf"(?<!\w)(?:{_phrases(ASKED)})\s+$", re.I)
AFTER_CUE = re.compile(rf"^\s(?:{_phrases(AFTER_PERSON)})(?!\w)")
ACT_CUE = re.compile(rf"^\s(?:{_phrases(ACTED)})(?!\w)")
TITLED = re.compile(rf"(?<![\w.]){TITLES}\.?{_B}(?:{_NAME}|(?:{_UP}\.{_B}?)?{_FAMILY})(?!\w)")
FULL = re.compile(rf"(?<![\w@.-])(?!(?:Call|Signed|Thanks|Dear|Letter|Note|Mail|Meeting|Ask|Tell|Contact|Tel|Phone|Ring|Email|Thank|Visit|Invite|Remind|Mobile|Attn|Frag|Frage)\b){_NAME}(?![\w@-])")
LONE = re.compile(rf"(?<![\w@.-]){_FAMILY}(?![\w@-])")
WORDS = re.compile(r"[^\W\d_]+")
INITIAL = re.compile(rf"(?<!\w){_UP}\.{_B}?{_UP}")
DASH = re.compile(r"\s–\s")


def _first_words(listed: str) -> set[str]:
    """The first word, as WORDS reads it, of each phrase: a text without any of them holds none of the phrases."""
    return {WORDS.search(p).group().lower() for p in listed.split("|") if WORDS.search(p)}


CUE_WORDS = _first_words(BEFORE_PERSON) | _first_words(ASKED) | _first_words(TITLES[3:-1])
ACT_WORDS = _first_words(AFTER_PERSON.replace("s?", "")) | _first_words(AFTER_PERSON.replace("s?", "s")) | _first_words(ACTED)
GIVEN_SMALL = {g.lower() for g in GIVEN}
# Articles and the like, by which a capitalised phrase is no name.
ARTICLES = set("the a an our my your his her their this that der die das den dem ein eine le la les un une el los las il lo gli o os as het een de".split())
PLACE = re.compile(r"^(?:Street|Road|Lane|Crescent|Rd|St|Avenue|Square|Row|House|Hall|Office|Garden|Bridge|River|Lake|Museum|School|Club|Room|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|May|June|July|August|September|October|November|December|Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag|Januar|Februar|März|Juni|Juli|Oktober|Dezember|Grid|Road|Mail|Note|Notes|Page|Box|Flat|Unit)$")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return bool(digits) and total % 10 == 0


def mod97(code: str) -> bool:
    """The IBAN rule: letters count as two digits, the first four characters go last."""
    s = re.sub(r"\W", "", code).upper()
    if not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def valid_id(code: str) -> bool | None:
    """True or False where a rule applies to the shape of the number, None where none does."""
    s = re.sub(r"[\s.\-/]", "", code).upper()
    if re.fullmatch(r"\d{8}[A-Z]", s):
        return "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:8]) % 23] == s[8]
    if re.fullmatch(r"[XYZ]\d{7}[A-Z]", s):
        return "TRWAGMYFPDXBNJZSQVHLCKE"[int(str("XYZ".index(s[0])) + s[1:8]) % 23] == s[8]
    if re.fullmatch(r"\d{11}", s):
        return sum(int(d) * w for d, w in zip(s, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1))) % 10 == 0
    if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", s):
        return mod97(s)
    if re.fullmatch(r"\d{13,19}", s):
        return luhn(s)
    return None


def find(text: str | None) -> list[tuple[int, int, str, float]]:
    """Spans (start, end, kind, score) of one text, not overlapping, in order."""
    if not text:
        return []
    spans: list[tuple[int, int, str, float]] = []
    words = {w.lower() for w in WORDS.findall(text)}
    _emails(text, words, spans)
    if DIGIT.search(text):
        if FIVE.search(text):
            _ids(text, spans)
        if SEVEN.search(text):
            _phones(text, spans)
        _addresses(text, words, spans)
    _names(text, words, spans)
    spans = sorted((s for s in spans if s[3] >= THRESHOLD), key=lambda s: (-s[3], s[0], s[0] - s[1]))
    kept: list[tuple[int, int, str, float]] = []
    taken = bytearray(len(text))
    for s in spans:
        if not any(taken[s[0] : s[1]]):
            kept.append(s)
            taken[s[0] : s[1]] = b"\x01" * (s[1] - s[0])
    return sorted(kept)


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    """Context of a span in its own line."""
    before = text[max(0, start - NEAR) : start]
    after = text[end : end + NEAR]
    return before[before.rfind("\n") + 1 :], after.split("\n", 1)[0]


def _emails(text: str, words: set[str], spans: list) -> None:
    if not PLAIN_AT.search(text):
        spelt = not words.isdisjoint({"at", "arroba", "chiocciola"})
        if not spelt or not (CAPITALS.search(text) or "(" in text or "[" in text or "{" in text or not words.isdisjoint({"dot", "punkt", "point", "punto"})):
            return
    for m in EMAIL_RE.finditer(text):
        got = m.group()
        sure = 0.95 if PLAIN_AT.search(got) or re.search(r"[\[({]", got) else 0.9 if re.search(r"\sAT\s.*\sDOT\s|\sat\s.*\sdot\s", got) else 0.2
        if sure == 0.2 and re.search(r"\sAT\s|[A-Z]{2,}", got) and "." in got.split()[-1]:
            sure = 0.6
        spans.append((m.start(), m.end(), EMAIL, sure))


def _ids(text: str, spans: list) -> None:
    for rule, base in IDS:
        for m in rule.finditer(text):
            code = m.group(1)
            digits = sum(c.isdigit() for c in code)
            if digits < 5:
                continue
            start, end = m.span(1)
            before, after = _around(text, start, end)
            score, ok = base, valid_id(code)
            if base < 0.7:
                if re.fullmatch(r"(?:\d[ -]?){12,18}\d|\d{11}", code) and ok is not True:
                    continue
                score += 0.35 if ok else -0.1 if ok is False else 0.0
                score += 0.3 if ID_WORDS.search(before) else 0.0
                score -= 0.4 if THING_WORDS.search(before[-24:]) else 0.0
            spans.append((start, end, ID, min(score, 0.97)))


def _phones(text: str, spans: list) -> None:
    for rule, base in PHONES:
        for m in rule.finditer(text):
            got = m.group()
            n = sum(c.isdigit() for c in got)
            if not 7 <= n <= 17:
                continue
            before, after = _around(text, m.start(), m.end())
            score = base
            score += 0.25 if PHONE_WORDS.search(before[-30:]) or PHONE_WORDS.search(after[:20]) else 0.0
            score -= 0.3 if THING_WORDS.search(before[-24:]) or re.match(r"\s?(?:pieces|items|mm|cm|kg|m|%|°|€|\$)", after) else 0.0
            score -= 0.3 if re.search(r"[€$£]\s?$", before) else 0.0
            if re.fullmatch(r"\d{4}[-/.]\d{2}[-/.]\d{2}.*|\d{1,3}(?:\.\d{1,3}){3}", got):
                score -= 0.6
            end = m.end()
            ext = re.match(r"\s?(?:ext\.?|x|extension|Durchwahl|poste)\s?\d{1,5}", text[end : end + 20])
            spans.append((m.start(), end + (ext.end() if ext else 0), PHONE, min(score, 0.95)))


def _addresses(text: str, words: set[str], spans: list) -> None:
    for gate, (rule, base) in zip(GATES, ADDRESSES):
        if not gate(words):
            continue
        for m in rule.finditer(text):
            spans.append((m.start(), m.end(), ADDRESS, base + 0.2))


def _names(text: str, words: set[str], spans: list) -> None:
    cued, acted = not words.isdisjoint(CUE_WORDS), not words.isdisjoint(ACT_WORDS) or bool(DASH.search(text))
    given = not words.isdisjoint(GIVEN_SMALL)
    if cued:
        for m in TITLED.finditer(text):
            if not PLACE.match(m.group().split()[-1]):
                spans.append((m.start(), m.end(), NAME, 0.9))
    if cued or given or acted:  # nothing else lifts a name over the threshold
        for m in FULL.finditer(text):
            got = m.group()
            parts = re.split(r"[,\s]+", got)
            before, after = _around(text, m.start(), m.end())
            score = 0.15
            score += 0.35 if (parts[-1] if "," in got else parts[0]) in GIVEN else 0.0
            score += 0.45 if STRONG_CUE.search(before) else 0.38 if ASK_CUE.search(before) else 0.0
            score += 0.38 if ACT_CUE.match(after) else 0.25 if AFTER_CUE.match(after) else 0.0
            score += 0.2 if got[1] == "." else 0.0
            score -= 0.6 if any(PLACE.match(w) for w in parts) or parts[0].lower() in ARTICLES else 0.0
            spans.append((m.start(), m.end(), NAME, min(score, 0.93)))
    if cued and (acted or given):
        for m in LONE.finditer(text):  # a family name alone needs a cue on both sides
            before, after = _around(text, m.start(), m.end())
            if len(m.group()) > 3 and STRONG_CUE.search(before) and AFTER_CUE.match(after) and not PLACE.match(m.group().split()[-1]):
                spans.append((m.start(), m.end(), NAME, 0.5))
    for w in words & GIVEN_SMALL:  # names typed without capitals need a given name and a cue
        for m in re.finditer(rf"(?<![\w@.+-]){w}{_B}(?:[^\W\d_]\.?{_B})?[^\W\d_]{{3,}}(?![\w@])", text):
            before, after = _around(text, m.start(), m.end())
            if STRONG_CUE.search(before) or AFTER_CUE.match(after) and not before.strip():
                spans.append((m.start(), m.end(), NAME, 0.7))


def redact(text: str | None) -> tuple[str | None, list[str]]:
    """The text with typed placeholders in place of the spans, and the kinds that occur."""
    if not text:
        return text, []
    out: list[str] = []
    kinds: set[str] = set()
    at = 0
    for start, end, kind, _ in find(text):
        out += (text[at:start], PLACEHOLDER[kind])
        kinds.add(kind)
        at = end
    return ("".join([*out, text[at:]]) if kinds else text), sorted(kinds)


REDACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])


@F.pandas_udf(REDACTED)
def redact_text(texts: pd.Series) -> pd.DataFrame:
    done = {t: redact(t) for t in texts.dropna().unique()}
    return pd.DataFrame([done[t] if isinstance(t, str) else (None, []) for t in texts], columns=["text", "kinds"])


def redact_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Add ``<column>_redacted`` and ``<column>_kinds`` for each text column.

    NULL gives NULL and no kinds, the empty text stays empty. Texts are read whole. Rows are neither
    added nor dropped, repeated texts are worked on once a batch, other columns pass through.
    """
    for c in columns:
        df = df.withColumn("__r", redact_text(F.col(c))).withColumn(f"{c}_redacted", F.col("__r.text")).withColumn(f"{c}_kinds", F.col("__r.kinds")).drop("__r")
    return df
