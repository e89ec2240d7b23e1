"""Text functions as Column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no signal in a keyword query (fixed values).
QUERY_STOP = (
    "the a an of to in on for and or is are was were how much many what which who whom when where why did do does "
    "i my me this that at by with all any from have has had still so"
).split()

#: Words too general to tell one purpose text from another (fixed values).
PURPOSE_STOP = (
    "a an the and or but of to in on for from with about into onto over under after before all any some this that these those is are be been "
    "was were it its as at by we you your my our their his her they them i me us will would should shall can could may might must do "
    "does did done not no yes if then than when what which who how why where everything anything "
    "keep keeps track tracks tracking watch watches watching manage manages managing follow follows handle handles collect collects capture captures agent agents "
    "every each new incoming sent received related message messages email emails mail mails inbox stuff thing things data info information items"
).split()

#: Tokens of pure acknowledgements (fixed values).
ACKNOWLEDGEMENTS = (
    "ok okay okey k kk yes yep yeah no nope sure thanks thank thankyou you thx ty cool great nice perfect awesome noted got it gotit done good fine "
    "lol haha hey hi hello morning night bye cheers sounds will do "
    "oui non merci super parfait nickel top genial daccord dac dacc ca marche bien recu vu compris entendu salut bonjour bonsoir allez go voila cest note impeccable"
).split()

#: Accented Latin letters and what they are without accents (fixed values).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words_array(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def strip_accents(c: Column | str) -> Column:
    return F.translate(_c(c), ACCENTED, PLAIN)


def slug_key(c: Column | str) -> Column:
    """Lower case, other characters to one _, one edge _ off each side."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(c))), "[^a-z0-9]+", "_"), "^_|_$", "")


def slugify(c: Column | str) -> Column:
    """As slug_key with accents taken off first and every edge _ gone."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(_c(c))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normalized_label(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip_accents(_c(c))), "[^a-z0-9]+", " "))


def normalized_key(label: Column | str, natural_keys: Column | None = None) -> Column:
    """The first natural key of email, phone, invoice_no, id (as #value), else the normalised label."""
    label = normalized_label(label)
    if natural_keys is None:
        return label
    strong = [F.nullif(F.lower(F.trim(F.element_at(natural_keys, k))), F.lit("")) for k in ("email", "phone", "invoice_no", "id")]
    return F.coalesce(F.concat(F.lit("#"), F.coalesce(*strong)), label)


def tokenize(c: Column | str) -> Column:
    """The distinct search terms of a query, in order."""
    raw = F.regexp_extract_all(F.lower(_c(c)), F.lit("[a-z0-9@._$-]+"), F.lit(0))
    stop = words_array(QUERY_STOP)
    return F.array_distinct(F.filter(raw, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t)))


def fold_plural(t: Column) -> Column:
    return F.when((F.length(t) > 4) & t.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(t, "es$", "")).when((F.length(t) > 3) & t.rlike("[^s]s$"), F.regexp_replace(t, "s$", "")).otherwise(t)


def normalize_terms(c: Column | str) -> Column:
    """Lexical profile terms: three letters or more, no stop words, plurals folded (repeats stay)."""
    raw = F.split(F.lower(_c(c)), "[^a-z0-9à-öø-ÿ]+", -1)
    stop = words_array(PURPOSE_STOP)
    return F.transform(F.filter(raw, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t)), fold_plural)


def key_terms(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(_c(c)), "[^a-z0-9%€$]+", -1), lambda t: F.length(t) >= 4))


def singularize(c: Column | str) -> Column:
    k = F.lower(F.trim(_c(c)))
    irregular = F.create_map(*(F.lit(x) for x in ("people", "person", "companies", "company", "entries", "entry", "parties", "party")))
    return F.when(k.isin("people", "companies", "entries", "parties"), irregular[k]).when(k.rlike("ies$"), F.regexp_replace(k, "ies$", "y")).when(k.rlike("(ses|xes|zes|ches|shes)$"), F.regexp_replace(k, "es$", "")).when(k.rlike("s$") & ~k.rlike("ss$"), F.regexp_replace(k, "s$", "")).otherwise(k)


def fold_plural_word(c: Column | str) -> Column:
    """A concept word's singular; -ss, -us and -is words stay."""
    w = _c(c)
    return F.when(w.rlike("(ss|us|is)$"), w).when(w.rlike("ies$"), F.regexp_replace(w, "ies$", "y")).when(w.rlike("(ses|xes|zes|ches|shes)$"), F.regexp_replace(w, "es$", "")).when(w.rlike("s$") & (F.length(w) > 3), F.regexp_replace(w, "s$", "")).otherwise(w)


def fold_concept_key(c: Column | str) -> Column:
    """A concept's key with its last word folded."""
    k = normalized_label(c)
    last = F.regexp_extract(k, "([^ ]*)$", 1)
    return F.concat(F.regexp_extract(k, "^(.* |)[^ ]*$", 1), fold_plural_word(last))


#: What a table's or column's name says about the kind of its rows (fixed values, in order).
KIND_RULES = (
    ("contact|people|person|lead|customer|client|attendee|member|guest|travel|passenger|employee|staff|owner|manager|assignee|host|recipient", "person"),
    (r"compan|vendor|supplier|account|organi|\borg\b|business|firm|brand|studio|agency", "company"),
    (r"invoice|\bbill\b", "invoice"),
    ("payment|expense|transaction|receipt", "payment"),
    ("product|item|sku|asset", "product"),
    ("project|deal|opportunity|engagement|campaign", "project"),
    ("order|shipment|delivery", "order"),
    ("task|ticket|issue", "task"),
)


def kind_from(c: Column | str) -> Column:
    name, out = F.lower(_c(c)), None
    for pattern, kind in KIND_RULES:
        out = F.when(name.rlike(pattern), kind) if out is None else out.when(name.rlike(pattern), kind)
    return out.otherwise(F.coalesce(F.nullif(singularize(c), F.lit("")), F.lit("record")))


def strip_html(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_c(c), "<[^>]+>", " "), r"\s+", " "))


def preview(c: Column | str, n: int = 200) -> Column:
    return F.substring(F.trim(F.regexp_replace(_c(c), r"\s+", " ")), 1, n)


def humanize(c: Column | str) -> Column:
    return F.replace(_c(c), F.lit("_"), F.lit(" "))


def snip(c: Column | str, n: int = 400) -> Column:
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def safe_segment(c: Column | str) -> Column:
    """A folder name that file systems take: at most 40 characters, 'unsorted' when nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.trim(_c(c)), r'[\\/:*?"<>|\x00-\x1f]+', "-"), r"\s+", " ")
    s = F.trim(F.substring(F.regexp_replace(s, r"^[.\- ]+|[.\- ]+$", ""), 1, 40))
    return F.when(s == "", "unsorted").otherwise(s)


def sanitize_folder_path(c: Column | str, depth: int = 4) -> Column:
    parts = F.filter(F.split(_c(c), "[/\\\\]+", -1), lambda p: F.trim(p) != "")
    path = F.array_join(F.transform(F.slice(parts, 1, depth), safe_segment), "/")
    return F.when(path == "", "unsorted").otherwise(path)


def is_cryptic_filename(c: Column | str) -> Column:
    """Names that say nothing: camera and scan counters, digests, bare numbers, no letters."""
    stem = F.regexp_replace(F.lower(_c(c)), r"\.[a-z0-9]{1,5}$", "")
    classes = (r"^(img|dsc|dscn|pxl|mvi|vid|scan|scn|doc|file|image|photo|screenshot|untitled|unknown|attachment|document)[-_ ]?[0-9]*$", r"^[0-9a-f]{8,}$", r"^[0-9a-f]{8}-[0-9a-f-]{27}$", r"^[0-9_\- .()]+$", r"^(img|pxl|vid|wa)[-_ ]?[0-9]{6,}.*$", r"^(scan|img|dsc)[a-z]*[-_ ]?[0-9]+[-_ ]?[0-9]*$", r"^[a-z]?[0-9]{5,}$", r"^tmp[a-z0-9_]*$", r"^whatsapp (image|audio|video).*$")
    out = ~stem.rlike("[a-z]")
    for pattern in classes:
        out = out | stem.rlike(pattern)
    return out


def file_slug(c: Column | str, suffix: str, n: int = 60, empty: str = "export") -> Column:
    s = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(strip_accents(_c(c))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, n), "-+$", "")
    return F.concat(F.when(s == "", empty).otherwise(s), F.lit(suffix))


def cited_sources(answer: Column | str, known: Column | str) -> Column:
    """The numbers cited as [n], in order of first mention, those in ``known`` only; null if there are none."""
    cited = F.array_distinct(F.transform(F.regexp_extract_all(_c(answer), F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int")))
    cited = F.filter(cited, lambda n: F.array_contains(_c(known), n))
    return F.when(F.size(cited) > 0, cited)


def trigrams(c: Column | str) -> Column:
    """The distinct trigrams of the words of a text, padded with two spaces before and one behind each."""
    words = F.filter(F.split(F.lower(_c(c)), "[^a-z0-9]+", -1), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two trigram sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def predicates_look_alike(a: Column | str, b: Column | str) -> Column:
    """One side's tokens are all in the other's, or their Jaccard similarity is a half or more."""
    a, b = _c(a), _c(b)
    ta, tb = (F.array_distinct(F.filter(F.split(x, "_", -1), lambda t: t != "")) for x in (a, b))
    shared = F.size(F.array_intersect(ta, tb))
    alike = (shared == F.size(ta)) | (shared == F.size(tb)) | (shared / F.size(F.array_union(ta, tb)) >= 0.5)
    return (a == b) | ((F.size(ta) > 0) & (F.size(tb) > 0) & alike)


def worth_extracting(text: Column | str, subject: Column | None = None, has_attachments: Column | None = None) -> Column:
    """False only for unmistakable acknowledgements and empty messages."""
    subject = F.lit(None).cast("string") if subject is None else subject
    attached = F.lit(False) if has_attachments is None else has_attachments
    both = F.trim(F.regexp_replace(F.concat(F.coalesce(subject, F.lit("")), F.lit("\n"), F.coalesce(_c(text), F.lit(""))), r"^\s+|\s+$", ""))
    plain = F.replace(F.regexp_replace(F.lower(strip_accents(both)), r"[^a-z\s']", " "), F.lit("'"), F.lit(""))
    tokens = F.filter(F.split(plain, r"\s+", -1), lambda t: t != "")
    ack = words_array(ACKNOWLEDGEMENTS)
    return (
        F.when(attached, True)
        .when(F.coalesce(F.lower(F.trim(subject)).rlike(r"^(note|notes|memo)\b"), F.lit(False)), True)
        .when(both == "", False)
        .when(F.length(both) > 80, True)
        .when(both.rlike(r"[0-9€$£%#@?]|https?://|www\."), True)
        .when(F.size(tokens) == 0, False)
        .when(F.size(tokens) > 6, True)
        .otherwise(~F.forall(tokens, lambda t: F.array_contains(ack, t)))
    )


def normalize_phone(c: Column | str, least_digits: int = 7) -> Column:
    """Digits with a leading +, if the text is nothing but a number of enough digits."""
    c = F.trim(_c(c))
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(c.rlike(r"^\+?[0-9 ().\-/]+$") & (F.length(digits) >= least_digits), F.concat(F.when(c.startswith("+"), "+").otherwise(""), digits)).otherwise(c)


def normalize_url(c: Column | str) -> Column:
    """The host in lower case; utm_*, fbclid and gclid parameters and a last slash gone."""
    c = F.trim(_c(c))
    head = F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    rest = F.substring(c, F.length(head) + 1, F.length(c))
    rest = F.regexp_replace(rest, r"(?<=[?&])(utm_[A-Za-z0-9_]*|fbclid|gclid)=[^&#]*(&|(?=#)|$)", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"[?&]+(?=#|$)", ""), r"/+(?=$|\?|#)", "")
    return F.when(head == "", c).otherwise(F.concat(F.lower(head), rest))


def normalize_unit(c: Column | str) -> Column:
    """Currency spellings to codes, pct to %; bare three-letter codes in upper case."""
    u = F.lower(F.trim(_c(c)))
    return (
        F.when(u.isin("$", "us$", "usd", "dollar", "dollars"), "USD").when(u.isin("€", "eur", "euro", "euros"), "EUR").when(u.isin("£", "gbp", "pound", "pounds"), "GBP").when(u.isin("¥", "jpy", "yen"), "JPY")
        .when(u.isin("pct", "percent", "%"), "%").when(u.rlike("^[a-z]{3}$"), F.upper(u)).otherwise(F.trim(_c(c)))
    )


def parse_sender(c: Column | str) -> Column:
    """struct(name, email) of 'Name <mail>' or a bare address."""
    c = F.trim(_c(c))
    email = F.nullif(F.lower(F.regexp_extract(c, r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+)", 1)), F.lit(""))
    name = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), '"', "")), F.lit(""))
    return F.struct(F.when(name.contains("@"), None).otherwise(name).alias("name"), email.alias("email"))


def attachment_kind(filename: Column | str, media: Column | str | None = None) -> Column:
    """pdf, sheet, text, image, audio or null by the name's ending, then the media type."""
    name = F.lower(_c(filename))
    media = F.lower(F.coalesce(_c(media), F.lit(""))) if media is not None else F.lit("")
    return (
        F.when(name.rlike(r"\.pdf$") | (media == "application/pdf"), "pdf").when(name.rlike(r"\.(xlsx|xls|csv|tsv)$") | media.rlike("spreadsheet|excel|csv"), "sheet")
        .when(name.rlike(r"\.(txt|md|markdown|json|log|html?)$") | media.startswith("text/"), "text").when(name.rlike(r"\.(png|jpe?g|gif|webp)$") | media.startswith("image/"), "image")
        .when(name.rlike(r"\.(mp3|m4a|wav|ogg|oga|opus|webm|flac)$") | media.startswith("audio/"), "audio")
    )


def safe_link(c: Column | str) -> Column:
    """The link if its scheme is allowed (or it has none), else null."""
    c = F.trim(_c(c))
    return F.when(c.rlike(r"(?i)^(https?:|mailto:|tel:|#|/(?!/))") | ~c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), c)


def wikilinks(c: Column | str) -> Column:
    """The targets of [[target|text]] links, in order, distinct."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(c), F.lit(r"\[\[([^\]|#\n]+)"), F.lit(1)), lambda x: F.trim(x)))


#: Plurals by themselves (fixed values).
IRREGULAR_PLURALS = (("person", "people"), ("company", "companies"), ("organization", "organizations"))


def plural(c: Column | str) -> Column:
    """A kind's name for many: y to ies after a consonant, es after a hiss, else s."""
    c = _c(c)
    out = F.when(c.rlike("[^aeiou]y$"), F.regexp_replace(c, "y$", "ies")).when(c.rlike("(s|x|z|ch|sh)$"), F.concat(c, F.lit("es"))).otherwise(F.concat(c, F.lit("s")))
    for one, many in IRREGULAR_PLURALS:
        out = F.when(F.lower(c) == one, many).otherwise(out)
    return out


def is_likely_scan(text: Column | str, pages: Column | str, least: int = 24) -> Column:
    """A paged document with fewer than ``least`` characters that aren't white space for each page."""
    return F.coalesce((_c(pages) >= 1) & (F.length(F.regexp_replace(_c(text), r"\s", "")) < least * _c(pages)), F.lit(False))


def transcript_body(summary: Column | str, transcript: Column | str, most: int = 8000) -> Column:
    """The summary, then the transcript under its heading, cut with a note; null where there is neither."""
    s, t = F.nullif(F.trim(_c(summary)), F.lit("")), F.nullif(F.trim(_c(transcript)), F.lit(""))
    cut_short = F.concat(F.rtrim(F.substring(t, 1, most)), F.lit("\n\n*… transcript truncated here — the full text is still searchable.*"))
    body = F.concat(F.lit("#### Transcript\n\n"), F.when(F.length(t) > most, cut_short).otherwise(t))
    return F.nullif(F.concat_ws("\n\n", s, body), F.lit(""))


def active_mention(c: Column | str, caret: Column | int | None = None) -> Column:
    """struct(start, query) of the @mention being typed at the caret (the end by default), else null.

    The @ begins the text or follows white space; the query is at most 40
    characters of one line.
    """
    c = _c(c)
    upto = c if caret is None else F.substring(c, F.lit(1), caret if isinstance(caret, Column) else F.lit(caret))
    query = F.regexp_extract(upto, r"(?s)(?:^|\s)@([^@\n]{0,40})\z", 1)
    found = upto.rlike(r"(?s)(?:^|\s)@[^@\n]{0,40}\z")
    return F.when(found, F.struct((F.length(upto) - F.length(query) - 1).alias("start"), query.alias("query")))


def strip_mention(c: Column | str, start: Column, end: Column) -> Column:
    """The text without the span, and without the doubled white space that leaves."""
    c = _c(c)
    joined = F.concat(F.substring(c, F.lit(1), start), F.substring(c, end + 1, F.length(c)))
    return F.regexp_replace(joined, r"(?s)^(.*?)(^|\s)\s", "$1$2")


def mention_rank(name: Column | str, query: str) -> Column:
    """0 for a prefix of the name, 1 of one of its words (or no query), 2 for a part, else null."""
    q, n = query.strip().lower(), F.lower(_c(name))
    if not q:
        return F.lit(1)
    return F.when(F.startswith(n, F.lit(q)), 0).when(F.exists(F.split(n, r"\s+"), lambda w: F.startswith(w, F.lit(q))), 1).when(F.contains(n, F.lit(q)), 2)


#: Words that accept and that reject (fixed values).
_YES, _NO = "(?:y|yes|ok|oui|approve|accept|confirm|👍|✓)", "(?:n|no|non|reject|decline|deny|👎|✗|x)"


def review_reply(c: Column | str, count: Column | int) -> Column:
    """struct(index, accept) of a reply like '1 yes', 'no 2', or a bare yes or no where one review is pending; else null."""
    t, n = F.lower(F.trim(_c(c))), count if isinstance(count, Column) else F.lit(count)
    number = F.nullif(F.regexp_extract(t, r"(\d{1,2})", 1), F.lit("")).cast("int")
    says = lambda word: t.rlike(rf"^\d{{1,2}}\s*{word}\z|^{word}\s*\d{{1,2}}\z")
    bare = lambda word: (n == 1) & t.rlike(rf"^{word}\z")
    reply = lambda index, accept: F.struct(index.alias("index"), F.lit(accept).alias("accept"))
    inside = (number >= 1) & (number <= n)
    out = F.when(says(_YES) & inside, reply(number, True)).when(says(_NO) & inside, reply(number, False)).when(bare(_YES), reply(F.lit(1), True)).when(bare(_NO), reply(F.lit(1), False))
    return F.when((n > 0) & (F.length(t) <= 24), out)


#: Media types by a file's ending (fixed values).
IMAGE_TYPES = (("png", "image/png"), ("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("webp", "image/webp"), ("gif", "image/gif"))
AUDIO_TYPES = (("mp3", "audio/mpeg"), ("m4a", "audio/mp4"), ("wav", "audio/wav"), ("ogg", "audio/ogg"), ("oga", "audio/ogg"), ("opus", "audio/ogg"), ("flac", "audio/flac"), ("webm", "audio/webm"))


def node_shape(kind: Column | str, key: Column | str, media: Column | str, url: Column | str, label: Column | str) -> Column:
    """struct(image, audio, url): the natural shape of a document (by its key's file name and its file_type) or of a bookmark."""
    ending = F.regexp_extract(F.lower(F.regexp_extract(F.coalesce(_c(key), F.lit("")), r"^doc:[^:]+:(.+)$", 1)), r"\.([a-z0-9]+)$", 1)
    said = F.trim(F.regexp_replace(F.lower(F.coalesce(_c(media), F.lit(""))), ";.*$", ""))
    by_ending = lambda types: F.element_at(F.create_map(*(F.lit(x) for pair in types for x in pair)), ending)
    known = lambda types: said.isin(*sorted({t for _, t in types}))
    document = _c(kind) == "document"
    image = F.when(document, F.when(known(IMAGE_TYPES), said).otherwise(by_ending(IMAGE_TYPES)))
    audio = F.when(document, F.coalesce(by_ending(AUDIO_TYPES), F.when(said.startswith("audio/"), said)))
    link = F.trim(F.coalesce(_c(url), _c(label)))
    return F.struct(image.alias("image"), audio.alias("audio"), F.when((_c(kind) == "bookmark") & link.rlike(r"(?i)^https?://\S+$"), link).alias("url"))
