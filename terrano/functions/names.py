"""Names of agencies and neighbourhoods: keys, display forms, licence numbers, garbled letters. Native expressions, null in, null out unless said."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from terrano.functions.normalize import clean, squeeze, unaccented

#: Words that names have in common (legal forms, trade).
LEGAL_WORDS = r"\b(?:s\.?a\.?|s\.?r\.?l\.?|s\.?a\.?s\.?|s\.?a\.?c\.?|inmobiliaria|propiedades|negocios|bienes raices|real estate|broker)\b"
#: Neighbourhoods with a spelling of their own.
NEIGHBOURHOODS = {
    "microcentro": "Centro", "centro": "Centro", "barrio norte": "Barrio Norte", "barrio sur": "Barrio Sur", "candioti norte": "Candioti Norte", "candioti sur": "Candioti Sur",
    "alto verde": "Alto Verde", "constitucion": "Constitución",
}
#: Words that no address keeps.
ADDRESS_WORDS = ("LOCAL", "GALERIA", "TORRE", "OFICINA", "EDIFICIO")
#: Licence numbers and the like inside names, in order.
LICENCES = (
    r"\bC\.?P\.?I\.?\s*\d{3,6}\b", r"\bC\.?U\.?C\.?I\.?C\.?B\.?A\.?\s*\d{3,6}\b", r"\bC\.?M\.?C\.?P\.?S\.?I\.?\s*\d{3,6}\b", r"\bC\.?S\.?I\.?\s*\d{3,6}\b", r"\bmat\.?\s*\d{3,6}\b",
    r"\bcol\.?\s*\d{3,6}\b", r"\breg\.?\s*\d{3,6}\b", r"\bcolegiado\s*\d{3,6}\b", r"\bmatr[íi]cula\s*\d{3,6}\b", r"\bdesde\s+\d{4}\b", r"\(\s*\w{0,10}\s*\d{4,6}\s*\)",
    r"\|\s*\d{1,2}\s*y\s*\d{1,2}\s*Ambientes?\b", r"\|\s*\w+\s*\d{3,5}\b",
)
#: Names that are no agency's: whole, as a part, as a beginning.
NOT_AGENCIES = ("-", "0341", "casa", "easy", "belgrano", "soldini", "leonadr", "lucymoda", "tía maria", "tia maria", "metalcoldart")
NOT_AGENCY_PARTS = (
    "hamburgues", "materiales para la construc", "metalúrgica", "metalurgica", "vivero ", "barrio privado", "country club", "cabañas:", "bahía apart", "bahia apart",
)
NOT_AGENCY_STARTS = (
    r"barrio\s+(privado|abierto|cerrado|la|el|los|las|del|nuevo|san|santa)", r"barrio\s+\w", r"loteo\b", r"country\b", r"complejo\b", "cabaña", r"caba[ñn]as\b", r"quinta\b", r"vivero\b",
    r"apart\b", r"edificio\b", r"departamento\s+\d", r"departamentos\s+(la|el|los|las|kairos|funes)", r"torres\s+de\b", r"parque\s+(juan|san|los|la)", r"paseo\s+(del|de\s+la|marqu)",
    r"centro\s+vecinal\b", r"alquilo\b", r"avenida\b", r"calle\s+\d", r"cosme\s+gorostiza\b", r"avellaneda\s+\d", r"aires\s+del\b", r"fincas\s+de\b", r"lotes\s+para\b",
    r"villa\s+(ocampo|del\s+carmen|libertador|la\s+angostura)\b", r"distrito\s+puerto\b", r"república\s+la\b",
)
#: Property types by their names, whole.
TYPE_NAMES = {
    "departamento": ("departamento", "depto", "ph", "departamento interno", "departamentointerno", "monoambiente", "piso", "apt", "flat"),
    "casa": ("casa", "chalet", "casa quinta", "quinta", "casas", "duplex", "dúplex", "triplex", "tríplex"),
    "terreno": ("terreno", "lote", "loteo", "parcela", "solar", "terrenos/lotes", "terrenos"),
    "local": ("local", "local comercial", "negocio", "locales"),
    "oficina": ("oficina", "oficina comercial", "office", "oficinas"),
    "cochera": ("cochera", "garage", "garaje", "cocheras"),
    "galpon": ("galpon", "galpón", "galpones"),
}
GARBLED = "[ÃÂ�]"
#: Garbled letters that the search page replaces, in order.
GARBLED_LETTERS = (
    ("Apto crÃ©dito", "Apto crédito"), ("Propiedad sin tÃ­tulo", "Propiedad sin título"), ("Propiedad sin tÃtulo", "Propiedad sin título"), ("Ã¡", "a"), ("Ã©", "e"), ("Ã­", "i"), ("Ã³", "o"),
    ("Ãº", "u"), ("Ã±", "n"), ("Ã\u0081", "A"), ("Ã‰", "E"), ("Ã\u008d", "I"), ("Ã“", "O"), ("Ãš", "U"), ("Ã‘", "N"),
)


def name_key(x: Column) -> Column:
    """Lower-case ASCII words with single spaces; empty text for null."""
    return F.trim(F.regexp_replace(unaccented(F.lower(F.coalesce(squeeze(x), F.lit("")))), "[^a-z0-9]+", " "))


def compare_key(x: Column) -> Column:
    """A name without legal forms, trade words and everything but letters, digits and underscores."""
    return F.regexp_replace(F.regexp_replace(unaccented(F.lower(F.trim(x))), "(?U)" + LEGAL_WORDS, ""), r"(?U)\W", "")


def spaced_key(x: Column) -> Column:
    """Lower case, no marks, no punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(unaccented(F.lower(F.trim(x))), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def title(x: Column) -> Column:
    """Upper case behind everything that is no letter, lower case elsewhere."""
    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"(?s)\p{L}+|\P{L}+"), 0), F.initcap), "")


def display_name(x: Column) -> Column:
    """A name without punctuation but &, without marks, title-cased; null if nothing is left."""
    return F.nullif(title(unaccented(F.regexp_replace(squeeze(x), r"(?U)[^\w\s&]", ""))), F.lit(""))


def capitalised(x: Column) -> Column:
    """Each word with a capital first letter, single spaces."""
    return F.initcap(F.lower(squeeze(x)))


def neighbourhood(x: Column) -> Column:
    """A neighbourhood's own spelling, or its words capitalised; null for blank."""
    out = capitalised(x)
    for key, name in NEIGHBOURHOODS.items():
        out = F.when(F.lower(squeeze(x)) == key, name).otherwise(out)
    return out


def last_part(x: Column) -> Column:
    """What follows the last hyphen; null if it is blank."""
    return squeeze(F.substring_index(x, "-", -1))


def street_part(x: Column) -> Column:
    """What precedes the first hyphen, without words of buildings and commas; null under five characters."""
    cut = F.substring_index(x, "-", 1)
    for word in ADDRESS_WORDS:
        cut = F.regexp_replace(cut, rf"(?iU)\b{word}\b", "")
    out = F.trim(F.regexp_replace(cut, r"(?U)[\s,]+", " "))
    return F.when(F.length(out) >= 5, out)


def without_licence(x: Column) -> Column:
    """A name without licence numbers, bars and hyphens at its ends, and a last dot that ends no abbreviation."""
    out = x
    for pattern in LICENCES:
        out = F.regexp_replace(out, "(?iU)" + pattern, "")
    out = F.btrim(F.regexp_replace(out, r"(?U)\s{2,}", " "), F.lit(" |-"))
    return F.trim(F.regexp_replace(out, r"(?<![A-Z])\.$", ""))


def recleaned(name: Column, stored: Column) -> Column:
    """The stored clean name's correction: set only where a licence number was cut and the result differs; null else."""
    new = without_licence(F.trim(name))
    return F.when((F.trim(name) != "") & stored.isNotNull() & (new != F.trim(name)) & (new != stored) & (F.length(new) >= 3), new)


def not_an_agency(x: Column) -> Column:
    """Whether a name is known not to be an agency's; null counts as empty."""
    low = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    parts = F.lit(False)
    for part in NOT_AGENCY_PARTS:
        parts = parts | F.contains(low, F.lit(part))
    return low.isin(*NOT_AGENCIES) | parts | F.rlike(low, F.lit("(?U)^(?:" + "|".join(NOT_AGENCY_STARTS) + ")"))


def regarbled(x: Column) -> Column:
    """Text whose UTF-8 was read as Latin-1, read anew if that leaves fewer garbled letters; else as it is."""
    fits = F.rlike(x, F.lit(GARBLED)) & ~F.rlike(x, F.lit(r"[^\x00-\xff]"))
    raw = F.encode(F.when(fits, x), "ISO-8859-1")
    fixed = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return F.coalesce(F.when((fixed != "") & (F.regexp_count(fixed, F.lit(GARBLED)) < F.regexp_count(x, F.lit(GARBLED))), fixed), x)


def garble_note(x: Column) -> Column:
    """What regarbled() did, for the record's metadata; null if nothing was garbled."""
    new = regarbled(x)
    return F.when(F.rlike(x, F.lit(GARBLED)), F.when(new != x, F.concat(F.lit("mojibake_corregido: "), x, F.lit(" -> "), new)).otherwise(F.concat(F.lit("posible_mojibake_sin_correccion: "), x)))


def shown_text(x: Column) -> Column:
    """Text as the search page shows it: garbled letters replaced by plain ones, trimmed; empty text for null."""
    out = F.coalesce(x, F.lit(""))
    for garbled, letter in GARBLED_LETTERS:
        out = F.replace(out, F.lit(garbled), F.lit(letter))
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def type_name(x: Column) -> Column:
    """A property type by its whole name; otro for others."""
    low = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    out = F.lit("otro")
    for kind, names in TYPE_NAMES.items():
        out = F.when(low.isin(*names), kind).otherwise(out)
    return out


def site(web: Column, keep_www: bool = False) -> Column:
    """A site in lower case without spaces and last slashes, with a scheme; null for blank. The key of sites has no www."""
    low = F.replace(F.lower(F.trim(web)), F.lit(" "), F.lit(""))
    full = F.rtrim(F.when(low.startswith("http"), low).otherwise(F.concat(F.lit("https://"), low)), F.lit("/"))
    return F.when(low != "", full if keep_www else F.regexp_replace(full, r"^(https?://)www\.", "$1"))


def cleaned_agency(df):
    """Agency rows with nombre_normalizado, web_normalizada, telefono, rating, resenas and categoria cleaned; the site itself stays as it is."""
    from terrano.functions import agencies as G, normalize as N, parsing as P

    c = F.col
    return df.withColumns(
        {
            "nombre_normalizado": display_name(c("nombre")),
            "web_normalizada": F.coalesce(site(c("web")), c("web")),
            "telefono": F.coalesce(N.phone(c("telefono")), c("telefono")),
            "rating": P.rating(c("rating")),
            "resenas": P.review_count(c("resenas")),
            "categoria": G.category(c("nombre"), c("categoria")),
        }
    )


def changed_fields(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """map of the fields whose new value differs and is set: what a correction has to write."""
    pairs = F.create_map(*(v for k in before for v in (F.lit(k), F.when(~after[k].eqNullSafe(before[k]), after[k].cast("string")))))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def first_phone(x: Column) -> Column:
    """The first Argentine phone number in a text, as digits with an optional plus; null if there is none."""
    pattern = r"(?:\+54|0054|011|0\d{2,4})[\s\-]?(?:15[\s\-]?)?\d{4}[\s\-]?\d{4}|\+54\s?9?\s?\d{2,4}[\s\-]?\d{4}[\s\-]?\d{4}|\(\d{2,4}\)\s?\d{4}[\s\-]?\d{4}"
    from terrano.functions.normalize import phone

    return phone(clean(F.regexp_extract(x, pattern, 0)))
