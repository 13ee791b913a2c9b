"""Names, labels and small scalar functions over IRIs and text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
DC = "http://purl.org/dc/elements/1.1/"
RICO = "https://www.ica.org/standards/RiC/ontology#"
EX = "http://example.org/archive/"
TYPE, LABEL, SUB_CLASS = RDF + "type", RDFS + "label", RDFS + "subClassOf"
TITLE, NAME = RICO + "title", RICO + "name"
#: Prefixes for short display names.
PREFIXES = {"rdf": RDF, "rdfs": RDFS, "skos": SKOS, "dc": DC, "rico": RICO, "ex": EX}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_name(iri: Column | str) -> Column:
    """What follows the last # or /; the whole IRI if that is its last character."""
    c = _col(iri)
    return F.when(F.substring(c, -1, 1).isin("#", "/"), c).otherwise(F.regexp_replace(c, "^.*[/#]", ""))


def prefixed(iri: Column | str) -> Column:
    """prefix:rest by the known prefixes, else the IRI itself."""
    c, out = _col(iri), None
    for name, base in PREFIXES.items():
        made = F.concat(F.lit(name + ":"), F.substring(c, len(base) + 1, 1 << 20))
        out = F.when(c.startswith(base), made) if out is None else out.when(c.startswith(base), made)
    return out.otherwise(c)


def expanded(name: Column | str) -> Column:
    """The IRI of prefix:rest; null if the prefix is not known and it is no absolute IRI."""
    c = _col(name)
    bases = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])
    base = F.try_element_at(bases, F.substring_index(c, ":", 1))
    return F.when(c.rlike("^[a-z]+://"), c).when(c.contains(":"), F.concat(base, F.regexp_replace(c, "^[^:]*:", "")))


def source_tag(iri: Column | str) -> Column:
    c = _col(iri)
    return F.when(c.startswith(RICO), "rico").when(c.startswith(DC), "dc").when(c.startswith(EX), "local").otherwise("other")


def encode_id(iri: Column | str) -> Column:
    """URL-safe base64 without padding."""
    plain = F.regexp_replace(F.base64(F.encode(_col(iri), "UTF-8")), r"[\r\n=]", "")
    return F.translate(plain, "+/", "-_")


def decode_id(coded: Column | str) -> Column:
    c = F.translate(_col(coded), "-_", "+/")
    padded = F.concat(c, F.repeat(F.lit("="), ((4 - F.length(c) % 4) % 4).cast("int")))
    return F.decode(F.unbase64(padded), "UTF-8")


def slug(text: Column | str) -> Column:
    """Lower case; every run of other than letters and digits is one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def hyphened(name: Column | str) -> Column:
    """camelCase as camel-case."""
    return F.lower(F.regexp_replace(_col(name), "([a-z0-9])([A-Z])", "$1-$2"))


def header_key(header: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(header)), "[^a-z0-9]", "")


def repeatable(value: Column | str) -> Column:
    """Parts between semicolons, trimmed, without blanks and the word null."""
    return F.filter(F.transform(F.split(F.coalesce(_col(value), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != "null"))


def picked_label(labels: DataFrame, lang: str, by: str = "s") -> DataFrame:
    """(by, label): that of the asked language, else English, else untagged, else any; the first in order among equals."""
    rank = F.when(F.col("o_lang") == lang, 0).when(F.col("o_lang") == "en", 1).when(F.coalesce("o_lang", F.lit("")) == "", 2).otherwise(3)
    return labels.groupBy(by).agg(F.min(F.struct(rank.alias("rank"), F.col("o").alias("label")))["label"].alias("label"))


def file_extension(name: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(name), r"\.([A-Za-z0-9]{1,8})$", 1))


def safe_file_name(name: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(name), r"^.*[/\\]", ""), "[^A-Za-z0-9._-]", "_")


def record_number(text: Column | str) -> Column:
    """The first R followed by digits, upper-cased; empty if there is none."""
    return F.upper(F.regexp_extract(_col(text), r"(?i)R\d+", 0))


def direct_link(url: Column | str) -> Column:
    """A sharing page's address as the address of the file itself."""
    c = _col(url)
    drive = F.concat(F.lit("https://drive.google.com/uc?export=download&id="), F.regexp_extract(c, r"/file/d/([^/?]+)", 1))
    box = F.concat(F.regexp_replace(F.regexp_replace(c, r"[?&]dl=\d", ""), "www.dropbox.com", "dl.dropboxusercontent.com"))
    return F.when(c.rlike(r"^https://drive\.google\.com/file/d/"), drive).when(c.rlike(r"^https://www\.dropbox\.com/"), box).otherwise(c)


def column_letters(index: Column | str) -> Column:
    """Spreadsheet letters of a column number from 0, up to three of them."""
    c = _col(index)
    letter = lambda k: F.char((F.lit(65) + k % 26).cast("int"))
    one, two = letter(c), F.concat(letter(F.floor(c / 26) - 1), letter(c))
    three = F.concat(letter(F.floor((c - 702) / 676)), letter(F.floor((c - 702) / 26) % 26), letter(c - 702))
    return F.when(c < 26, one).when(c < 702, two).otherwise(three)
