"""Template residue and error-page text (problem 9).

1. Texts are cut into lines and sentences in the JVM; numbers and names inside them are masked, but no status code and
   no word that messages are made of, so what a mask says is what each of its segments says. Equal masks are counted once.
2. Templates are mined from the masks by a prefix tree of fixed depth: number of tokens, then the first tokens; in a
   leaf a mask joins the template it shares most tokens with, if enough, and its differing tokens become wildcards.
   Masks that say a message by themselves come first; they start message templates, which others may join only where
   they agree closely.
3. Each template is classified once, and all its masks have its verdict: a message (error, refusal, not ready, gone,
   private, script or browser notice) or filler if a message started it, else content. Headings, menus and reference
   numbers are neutral.
4. Verdicts go back to the documents. A content template found in several different texts, (nearly) all of which have
   messages, belongs to them, as ``Check the spelling of the address``. One found in one text only tells nothing by
   itself; it is content where such templates say more than the messages beside them. A document with a message or
   filler and no content is residue.
5. Apart from that, a document with an unresolved slot of a template language is residue, unless the slot stands in
   code, in quotes, or as the thing that is written or typed (``write {{name}} in a cell``).

Null, empty and blank texts are no residue. Texts are read whole. A leaf of very many masks is mined in several parts,
whose templates are then mined together.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, durable, lookup

DEPTH, SIMILARITY = 3, 0.6
#: Tokens that a mask must share with a message template which it doesn't say by itself.
MESSAGE_SIMILARITY = 0.75
#: A template is a companion of messages if so many of its texts have one, and at least so many.
COMPANION_SHARE, COMPANION_TEXTS = 0.8, 2
#: A word is one of filler if so many masks of filler have it, and such a share of all its masks; filler has such a share of them.
FILLER_MASKS, FILLER_SHARE, FILLER_WORDS = 3, 0.5, 0.6
#: Distinct masks that one task mines.
LEAF_MASKS = 20_000

# The marks of template languages, as regular expressions that Java and Python read alike.
SLOTS = [
    r"\{\{\{?[^{}\n]+\}?\}\}", r"\$\{[^{}\n]+\}", r"#\{[^{}\n]+\}", r"\{%[^%\n]+%\}", r"<%[^%\n]+%>", r"<<[^<>\n]+>>", r"\[\[[^\[\]\n]+\]\]",
    r"%\([^()\n]+\)[sdif]", r"%[A-Z\p{Lu}][\p{Lu}_]+%", r"\$[\p{Lu}][\p{Lu}_]+\$", r"__[\p{Lu}\p{Lo}][\p{Lu}\p{Lo}_]*__", r"##[\p{L}][\p{L}_ ]*##", r"@@[\p{L}][\p{L}_ ]*@@", r"\*\|[^|\n]+\|\*",
    r"XXX [^\n]+? XXX", r"&lt;[\p{L}][\p{L}_ ]*&gt;", r"(?<![\p{L}])YOUR_[^ \n]+_HERE",
    r"\{[\p{L}\p{N}_][\p{L}\p{N}_.-]*\}", r"«[\p{L}][\p{L}\p{N}_]*»",
    r"\[(?:insert|add|your|enter|put|write|choose|select|fill in)\s[^\[\]\n]+\]", r"\[[^\[\]\n]+(?:goes here| here)\]", r"\[\p{Lu}[\p{Lu}_]+(?: [\p{Lu}_]+){0,4}\]", r"\[\p{Lo}+\]",
    r"<(?:insert|add|your|enter|put|write|choose|select) [^<>\n]+>", r"<\p{Lu}[\p{Lu}_]+(?: [\p{Lu}_]+){0,4}>", r"<\p{Lo}+>",
    r"\((?:insert|add your|enter|put your) [^()\n]+\)",
]
SLOT = "|".join(SLOTS)
#: Marks one of which every slot has, quick to look for.
SLOT_HINT = r"(?=[{<\[«@#_*X&Y%$(])(?:[{<«]|\[(?!\d{1,4}\])|@@|##|__|\*\||XXX |&lt;|YOUR_|%[\p{Lu}(]|\$\p{Lu}|\((?:insert|add|enter|put) )"
_said = r"(?i:write|type|quoted as|written as|spelled|syntax|placeholders?|variables?|tags?|macros?|markup|notation|schreib\w*|escrib\w*|écri\w*|escrev\w*)"
#: Slots that are spoken about: directly behind a word for writing them, in quotes, or said to be written.
MENTION = rf"\b{_said}\s*[:=]?\s*(?:{SLOT})|[\"“‘']\s*(?:{SLOT})\s*[\"”’']|(?:{SLOT})\s+(?:is|are|was|were) (?:written|quoted|typed|spelled|expanded|replaced)\b"
CODE = r"(?s)```.*?(?:```|$)|~~~.*?(?:~~~|$)|`[^`\n]*`"
LINE_MARKS = "。！？"
# both begin with a look at one class of characters, which fails fast almost everywhere
CUT = "(?=[ \t\r\n\x0b\x0c\u0085\u00a0\u2028\u2029])(?:[\r\n\x0b\x0c\u0085\u2028\u2029]+|[ \t\u00a0](?<=[.!?…][ \t\u00a0])[ \t\u00a0]*)"

# What messages and filler say, in the languages of the corpus.
_scripts = r"(?:java ?script|js|(?:client-side )?script(?:s|ing)?(?: execution)?|cookies)"
MESSAGES = re.compile(
    "|".join(
        [
            # scripts, browsers, robots
            rf"(?:enable|activate|allow|turn on|switch on|requires?|needs?|without|works only with|please use|blocks?) (?:\w+ ){{0,3}}{_scripts}\b", rf"\b{_scripts}(?: and cookies)? (?:is|are|seems? to be|must be) (?:\w+ )?(?:disabled|required|needed|off|turned off|blocked|enabled)",
            r"<noscript>|\(noscript\)", r"^(?:please )?(?:enable|activate|allow|turn on|switch on) it\b", r"browser (?:is (?:too old|not supported|outdated|out of date)|does not (?:seem to )?support|blocks)", r"(?:update|upgrade) your browser|(?:newer|modern|supported) browser",
            r"checking your browser|verify (?:that )?you are (?:a )?human|not a robot|captcha|unusual traffic", r"if nothing happens", r"^loading\b.{0,40}(?:…|\.\.\.)$", r"ddos protection|ray id",
            r"javascript (?:aktivieren|activ|para|pour|per|benötigt)|benötigt javascript|javascript (?:ist )?(?:deaktiviert|ausgeschaltet)|javascriptを|active (?:el |le )?javascript|activez javascript|activer javascript|ative o javascript|habilite (?:el |o )?javascript|navigateur bloque|(?:necesita|precisa de|nécessite|nécessaires?|benötigt) (?:\w+ )?(?:scripts?|javascript)|scripts nécessaires|skripte? (?:\w+ ){0,3}(?:aktiv|benötigt|erforderlich)|スクリプト(?:が|を)|ブラウザ(?:が|は|の|を)|cookies? (?:akzeptieren|aceptar|activées)|navegador (?:no|não|bloquea|bloqueia|es demasiado|é muito)|navigateur (?:est|ne)|ihr browser",
            # errors
            r"^(?:http |error |status |code |fehler |erreur |erro )*#?\s*(?:404|403|401|400|408|410|429|500|502|503|504)\b[\s.:|–—-]*", r"(?:page|file|profile|record|listing|address|site|link|url|entry|resource|document) (?:was |could )?not (?:be )?(?:found|exist|available|load)", r"(?:could|can|did) ?n[o']t (?:find|load|reach|resolve|open|display|be (?:found|loaded|reached|displayed|drawn|shown))", r"couldn.t (?:find|load|reach)|can.t be reached",
            r"(?:nothing|no (?:page|profile|content|record|results?|company)) (?:lives|exists|matches|was found|to see|could be|can be)\b.{0,40}$|no longer (?:exists?|available)|never existed|has (?:moved|expired|been (?:removed|deleted|taken down|suspended|moved|disabled))\b.{0,30}$|is broken\.?$|was removed at", r"internal server error|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|not found\.?$|request timed? ?out|too many requests|rate limit|upstream (?:timeout|host)|took too long|err_[a-z_]+|application error|unexpected (?:error|condition)|something went wrong|we hit a snag|fatal error|uncaught|exception (?:at|in)|nullreference|stack trace|handshake failed|connection (?:reset|refused|timed)|fetch failed|gone away in|warning: |segmentation fault|could not resolve host|parse error|unable to (?:display|load|connect)",
            r"^\{\s*\"[a-z_]+\"\s*:", r"^oops\b", r"try again (?:later|in)|temporarily unavailable|please (?:come back|try|reload|refresh)|refresh the page|reload the page|come back later|back shortly|down for maintenance|under maintenance|scheduled maintenance",
            r"seite nicht gefunden|nicht (?:mehr )?(?:gefunden|erreichbar|verfügbar)|gibt es nicht mehr|interner (?:server)?fehler|serverfehler|versuchen sie es|später erneut|zugriff verweigert|keine berechtigung|wartungsarbeiten|wird gewartet|in wartung|sitzung ist abgelaufen|fehler aufgetreten",
            r"página no (?:encontrada|existe|disponible)|ya no existe|error interno|vuelva a intentarlo|inténtelo (?:de nuevo|más tarde)|acceso (?:denegado|prohibido)|en mantenimiento|sesión ha (?:caducado|expirado)|no tiene permiso|no disponible|fuera de servicio",
            r"page (?:introuvable|non trouvée)|n.existe (?:plus|pas)|erreur interne|réessayer plus tard|veuillez réessayer|accès (?:refusé|interdit)|(?:momentanément|temporairement) indisponible|en maintenance|session a expiré|pas l.autorisation|est indisponible|introuvable",
            r"página não (?:encontrada|existe)|não existe\b.{0,10}$|erro interno|tente (?:de novo|novamente)|acesso (?:negado|proibido)|em manutenção|sessão (?:expirou|expirada)|não tem permissão|indisponível",
            r"ページが見つかりません|見つかりません|ご確認ください|サーバーエラー|エラーが発生|しばらくして|再度お試し|アクセスが(?:拒否|できません)|権限がありません|メンテナンス|表示できません|有効にしてください|存在しません|期限が切れ|ご利用(?:になれ|いただけ)",
            # refusals, private, gone, not ready
            r"access denied|^forbidden|\bforbidden\.?$|unauthorized|not (?:allowed|authorized|authorised|permitted) to|permission (?:denied|to view)|sign in to|log in to|please (?:sign|log) in|must be (?:signed|logged) in|session has expired|(?:profile|page|account|site) is private|account has been|not available in your (?:country|region)|^blocked\b|ask the administrator|members only|subscribers only|token expired",
            r"under construction[.!: –—-]|^under construction|^(?:page|site) in progress|coming soon|watch this space|content will follow|still writing this|new site is on its way|not (?:added|published|written) (?:a |an |any )?\w* ?yet|tell you when we open|domain (?:is|may be) for sale|buy this domain|parked (?:domain|free)|nothing to see here|site is (?:being|not ready|closed)|launching soon|opening soon",
            r"im aufbau|in bearbeitung|demnächst|bald verfügbar|en construcción|próximamente|en construction|bientôt disponible|à venir\.?$|em construção|em breve|準備中|工事中|近日公開|非公開|privates? profil|perfil privado|profil privé",
            # filler
            r"lorem ipsum|\blorem\b|dolor sit amet|(?:dummy|sample|filler|placeholder|example) (?:paragraph|text|copy|content|sentence)|your (?:headline|text|title|tagline|name|story) here|(?:headline|text|title) goes (?:here|in)|click (?:edit|here) to (?:change|edit)|replace this (?:paragraph|text)|use this space to|add a short paragraph|describe your (?:product|company)|caption for the|^section title\b|will be replaced before|fill up the (?:column|page|space)|words to fill|type your text|edit this text|check the layout",
            r"blindtext|platzhalter(?:text)?|hier steht (?:bald )?(?:ein|ihr) text|texto (?:de (?:ejemplo|relleno|exemplo|preenchimento)|aquí|aqui)|(?:su|tu|seu) texto|faux texte|votre texte|texte (?:de remplissage|factice)|ダミーテキスト|文章が入ります|サンプルテキスト|テキストが入ります|仮の(?:文章|テキスト)",
        ]
    ),
    re.I,
)
#: Every message has one of these in lower case; looking for them first saves most of the time.
HINTS = (
    "script|js|cookie|activate it|enable it|turn on it|switch on it|allow it|browser|navegador|navigateur|human|robot|captcha|traffic|nothing|loading|ddos|ray id|ブラウザ|スクリプト|404|403|401|400|408|410|429|500|502|503|504|not |n't |n’t |found|exist|available|matches|lives|to see|could be|can be|no longer|moved|expired|removed|deleted|taken down|suspended|"
    "disabled|broken|error|gateway|unavailable|timed|time-out|timeout|too many|rate limit|too long|err_|condition|went wrong|snag|uncaught|exception|nullref|stack trace|handshake|connection|fetch failed|gone away|warning:|segmentation|resolve host|unable to|{|oops|try again|come back|refresh|reload|maintenance|back shortly|please |"
    "gefunden|erreichbar|verfügbar|nicht|fehler|versuchen|erneut|verweigert|berechtigung|wartung|gewartet|sitzung|encontrada|existe|disponible|vuelva|inténtelo|denegado|prohibido|mantenimiento|sesión|permiso|servicio|introuvable|trouvée|erreur|réessayer|refusé|interdit|indisponible|session|autorisation|erro |tente|negado|proibido|manutenção|sessão|permissão|indisponível|"
    "見つか|確認|エラー|しばらく|再度|アクセス|権限|メンテ|表示|有効|存在|期限|利用|denied|forbidden|unauthorized|allowed|authori|permi|sign in|log in|signed|logged|private|account|country|region|blocked|administrator|members only|subscribers|token|construction|in progress|coming soon|watch this|will follow|still writing|on its way|yet|when we open|for sale|this domain|parked|closed|not ready|being|opening soon|launching|"
    "aufbau|bearbeitung|demnächst|bald|próximamente|bientôt|venir|em breve|construção|construcción|準備中|工事中|公開|privat|profil privé|perfil|lorem|dolor sit|dummy|sample|filler|placeholder|example|here|click|replace|this space|paragraph|describe your|caption|section title|headline|words to fill|fill up|type your|edit |edit this|layout|goes|blindtext|platzhalter|steht|texto|texte|ダミー|文章|サンプル|テキスト|仮の|will be"
).split("|")
FIELD = re.compile(r"^[\w -]{2,24}\*?\s*[:：]\s*(?:text|description|answer|value|content|title|name|to be (?:written|added|defined|filled)|tbd|tba|tbc|todo|xxx+|lorem|n/?a|\.{2,}|…|-+|_+)\.?$", re.I)
LATIN = set("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat vel quam tempus sapien mattis luctus viverra ornare gravida mollis nulla pellentesque fermentum vestibulum".split())
WORDS = re.compile(r"\w+")
TRAIL = re.compile(r"^[\W\d_]*$|^(?:ref|incident|request id|id|case|trace|code|error|http|status|step|page)?\W*#?\W*(?:[*0-9a-f]+\W*)$", re.I)


try:  # one pass for all hints
    import ahocorasick

    _hints = ahocorasick.Automaton()
    for _h in HINTS:
        _hints.add_word(_h, _h)
    _hints.make_automaton()

    def hinted(low: str) -> bool:
        return next(_hints.iter(low), None) is not None

except ImportError:

    def hinted(low: str) -> bool:
        return any(h in low for h in HINTS)


def classify(segment: str) -> str:
    """``message``, ``filler``, ``neutral`` or ``content``: what one line or sentence is, by itself."""
    s = segment.strip()
    words = WORDS.findall(s.lower())
    if not words or TRAIL.match(s):
        return "neutral" if not re.match(r"(?:error |http )?[45]\d\d\W*$", s, re.I) else "message"
    if len(words) >= 6 and len(set(words)) <= min(4, max(2, len(words) // 12)):
        return "message"
    low = s.lower()
    if FIELD.match(s) or hinted(low) and MESSAGES.search(s):
        return "message"
    latin = sum(w in LATIN for w in words)
    if latin >= 2 and latin >= 0.2 * len(words) and len({w for w in words if w in LATIN}) >= 2:
        return "filler"
    ends = s[-1] in ".!?。！？"
    # a heading, a menu, a byline
    return "neutral" if len(words) <= 7 and not ends and len(s) <= 70 and not re.search(r"[ぁ-んァ-ン]", s) else "content"


# How capitalised words begin that messages are made of; such words are never masked.
TELLING = (
    "Page Seite Página Pagina Site Website Not Found No Error Fehler Err Java Script Skript Brows Naveg Navig Cookie Access Acces Acceso Accès Denied Forbidden Gateway Time Server Service Unavail Mainten Manten Wartung Zugriff Log Sign Please Bitte Enable Activ Aktiv Disab "
    "Loading Try Retry Under Construction Coming Soon Lorem Ipsum Text Your Private Privat Account Blocked Captcha Robot Human Closed Content Http Null Exception Request Connect Warning Fatal Sitzung Session Sesi Berechtig Inhalt Blind Platz Titel Title Headline Oops Sorry "
    "Unauthor Upgrade Update Ray Domain Profil Perfil Subscri Members Admin"
).split()
_telling = "|".join(f"{c}(?:{'|'.join(sorted(w[1:] for w in TELLING if w[0] == c))})" for c in sorted({w[0] for w in TELLING}))
_name = rf"(?!{_telling})\p{{Lu}}[\p{{Ll}}'’][\p{{L}}'’-]*"
MASKED = rf"(?<![\p{{L}}\p{{N}}])(?:(?![45]\d\d(?![\d.,]*\d))\d[\d.,]*%?|[0-9a-f]{{8}}|(?<=[\p{{Ll}},;:] ){_name}(?:[ &]+{_name})*|^{_name}(?: {_name})+)"


def mask(c: Column) -> Column:
    """A segment with numbers other than status codes, reference codes and names masked."""
    return F.regexp_replace(c, MASKED, "*")


class Tree:
    """The templates of one leaf of the prefix tree; those of messages and others."""

    def __init__(self, similarity: float = SIMILARITY, message_similarity: float = MESSAGE_SIMILARITY):
        self.similarity, self.message_similarity = similarity, message_similarity
        self.templates: list[list[str]] = []
        self.message: list[bool] = []
        self.at: dict[tuple[int, str], list[int]] = {}

    def add(self, tokens: list[str], message: bool = False) -> int:
        """The number of the template a mask belongs to, which takes on its differences as wildcards.

        Sharing so many tokens, mask and template share one of the first places; only such templates are compared.
        """
        n = len(tokens)
        best, most = -1, 0.0
        places = n - math.ceil(self.similarity * n - 1e-9) + 1
        for i in sorted({i for p in range(min(places, n)) for i in self.at.get((p, tokens[p]), ())}):
            if message and not self.message[i]:
                continue
            same = sum(a == b for a, b in zip(self.templates[i], tokens)) / n
            if same >= (self.similarity if message or not self.message[i] else self.message_similarity) and same > most:
                best, most = i, same
        if best < 0:
            self.templates.append(list(tokens))
            self.message.append(message)
            for p in range(min(places, n)):
                self.at.setdefault((p, tokens[p]), []).append(len(self.templates) - 1)
            return len(self.templates) - 1
        t = self.templates[best]
        for i, (a, b) in enumerate(zip(t, tokens)):
            if a != b:
                t[i] = "*"
        return best


def segments(text: Column) -> Column:
    """The lines and sentences of a text."""
    for mark in LINE_MARKS:
        text = F.replace(text, F.lit(mark), F.lit(mark + "\n"))
    return F.split(text, CUT)


def _mine(rows: DataFrame, tasks: int) -> DataFrame:
    """``mask_id, leaf, template, tokens, message`` of ``mask_id, mask, n, verdict, leaf, salt``; each leaf and salt whole in a task."""
    bounds = SIMILARITY, MESSAGE_SIMILARITY

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        trees: dict[tuple[int, int], Tree] = {}
        pdf = pdf.sort_values(["verdict", "n", "mask"], ascending=[False, False, True], ignore_index=True)
        out = []
        for leaf, salt, mask_id, m, verdict in zip(pdf["leaf"].tolist(), pdf["salt"].tolist(), pdf["mask_id"].tolist(), pdf["mask"].tolist(), pdf["verdict"].tolist()):
            tree = trees.setdefault((leaf, salt), Tree(*bounds))
            out.append((mask_id, leaf, salt, tree.add(m.split(), bool(verdict))))
        found = [trees[leaf, salt] for _, leaf, salt, _ in out]
        keys = [f"{leaf}.{salt}.{i}" for _, leaf, salt, i in out]
        return pd.DataFrame({"mask_id": [r[0] for r in out], "leaf": [r[1] for r in out], "template": keys, "mask": [" ".join(t.templates[r[3]]) for t, r in zip(found, out)], "message": [t.message[r[3]] for t, r in zip(found, out)], "size": pdf["mask"].str.len()})

    part = F.pmod(F.xxhash64("leaf", "salt"), F.lit(tasks)).cast("int")
    return rows.withColumn("part", part).groupBy("part").applyInPandas(run, "mask_id long, leaf long, template string, mask string, message boolean, size int")


def mine(masks: DataFrame) -> DataFrame:
    """``mask_id, template, message, size`` (in characters) of distinct masks (``mask_id, mask, n, verdict``; a verdict of 1 is a message).

    A template is a message if one started it.
    """
    tokens = F.split(F.trim("mask"), r"\s+")
    rows = masks.withColumn("leaf", F.xxhash64(F.size(tokens), F.slice(tokens, 1, DEPTH))).withColumn("salt", F.lit(0))
    leaves = rows.groupBy("leaf").agg(F.count("*").alias("c"))
    size = leaves.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("all"), F.coalesce(F.max("c"), F.lit(0)).alias("most")).first()
    tasks = max(masks.sparkSession.sparkContext.defaultParallelism, -(-size["all"] // LEAF_MASKS))
    if size["most"] <= LEAF_MASKS:
        return _mine(rows, tasks).select("mask_id", "template", "message", "size")
    large = durable(leaves.where(F.col("c") > LEAF_MASKS).select("leaf", F.ceil(F.col("c") / LEAF_MASKS).alias("parts")))
    rows = durable(rows)
    salted = lookup(rows.drop("salt"), large, "leaf").withColumn("salt", F.pmod(F.xxhash64("mask_id"), F.coalesce("parts", F.lit(1))).cast("int"))
    first = durable(_mine(salted, tasks))
    parts = first.groupBy("template").agg(F.first("leaf").alias("leaf"), F.first("mask").alias("mask"), F.count("*").alias("n"), F.max("message").cast("int").alias("verdict"), F.lit(0).alias("salt"))
    parts = durable(parts.withColumn("mask_id", F.monotonically_increasing_id()))
    second = _mine(parts, tasks).select("mask_id", F.col("template").alias("whole"), F.col("message").alias("whole_message"))
    second = parts.select("mask_id", F.col("template").alias("part_template")).join(second, "mask_id").drop("mask_id")
    merged = lookup(first.withColumnRenamed("template", "part_template"), durable(second), "part_template", "inner")
    return merged.select("mask_id", F.col("whole").alias("template"), F.col("whole_message").alias("message"), "size")


def filled(said: DataFrame) -> DataFrame:
    """``mask_id`` of the content masks made of words that filler is made of; ``said`` has ``mask_id, mask, verdict``.

    Words are told by the masks known for filler (a verdict of 2) among all that have the word.
    """
    words = said.where("verdict <> 1").select("mask_id", "verdict", F.array_distinct(F.split(F.translate(F.lower("mask"), ".,;:!?()*\"…", ""), " ")).alias("ws"))
    words = words.select("mask_id", "verdict", F.filter("ws", lambda w: w != "").alias("ws"))
    each = words.select("mask_id", "verdict", F.size("ws").alias("size"), F.explode("ws").alias("w"))
    each = each.join(each.where("verdict = 2").select("w").distinct(), "w")
    counts = each.groupBy("w").agg(F.sum((F.col("verdict") == 2).cast("long")).alias("f"), F.count("*").alias("all"))
    vocabulary = durable(counts.where((F.col("f") >= FILLER_MASKS) & (F.col("f") >= FILLER_SHARE * F.col("all"))).select("w"))
    hits = each.where("verdict = 0 and size > 2").join(vocabulary, "w").groupBy("mask_id", "size").agg(F.count("*").alias("hits"))
    return hits.where(F.col("hits") >= FILLER_WORDS * F.col("size")).select("mask_id")


def unresolved(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids of the documents with an unresolved slot outside code that isn't merely spoken about."""
    bare = F.regexp_replace(F.col(text_col), CODE, " code ")
    hinted = docs.where(F.col(text_col).rlike(SLOT_HINT)).select(id_col, F.explode(segments(bare)).alias("s"))
    return hinted.where(F.col("s").rlike(SLOT_HINT)).where(F.regexp_replace("s", MENTION, " ").rlike(SLOT)).select(id_col).distinct()


def residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of the documents that are residue, once each. Other columns are ignored; null ids are left out."""
    docs = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    # repeated texts count once; what is left of invisible characters has no word and so is neutral
    rows = docs.select("d", "t", F.xxhash64("t").alias("text_id")).select("d", "text_id", F.explode(segments(F.col("t"))).alias("s")).where(F.trim("s") != "")
    rows = rows.select("d", "text_id", F.trim(mask(F.col("s"))).alias("mask"))
    seed = 0
    while True:
        coded = durable(rows.select("d", "text_id", F.xxhash64(F.lit(seed), "mask").alias("mask_id"), "mask"))
        masks = durable(coded.groupBy("mask_id", "mask").agg(F.count("*").alias("n")))
        if masks.groupBy("mask_id").count().where("count > 1").isEmpty():
            break
        discard(coded)  # two masks with one hash: take another seed
        seed += 1

    def judge(batches):
        for pdf in batches:
            verdicts = {"filler": 2, "message": 1, "content": 0, "neutral": -1}
            yield pdf.assign(verdict=[verdicts[classify(m)] for m in pdf["mask"]])

    spread = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    said = durable(masks.repartition(spread).mapInPandas(judge, "mask_id long, mask string, n long, verdict int").where("verdict >= 0"))
    filler = filled(said)
    said = said.join(filler.withColumn("filler", F.lit(1)), "mask_id", "left").select("mask_id", "mask", "n", F.greatest(F.least("verdict", F.lit(1)), F.coalesce("filler", F.lit(0))).alias("verdict"))
    known = durable(mine(said))
    marked = durable(lookup(coded.select("d", "text_id", "mask_id"), known, "mask_id", "inner").select("d", "text_id", "template", "message", "size"))
    suspects = durable(marked.where("message").groupBy("d").agg(F.sum("size").alias("said")))
    # only what stands in suspect documents can be a companion
    plain = marked.where("not message")
    beside = durable(plain.join(suspects, "d"))
    with_message = durable(beside.groupBy("template").agg(F.count_distinct("text_id").alias("with_message")))
    share = plain.join(with_message.select("template"), "template", "left_semi").groupBy("template").agg(F.count_distinct("text_id").alias("n")).join(with_message, "template")
    lone = F.col("n") < COMPANION_TEXTS
    other = share.where(lone | (F.col("with_message") < COMPANION_SHARE * F.col("n"))).select("template", lone.alias("lone"))
    content = beside.join(other, "template").groupBy("d", "said").agg(F.min("lone").alias("lone"), F.sum("size").alias("size"))
    content = content.where("not lone or size > said").select("d")
    whole = suspects.select("d").join(content, "d", "left_anti")
    slots = unresolved(docs, "d", "t")
    return whole.unionByName(slots).distinct().select(F.col("d").alias(id_col))
