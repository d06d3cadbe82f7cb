"""Scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of tags and their canonical form.
ALIASES = {
    "pixelart": "pixel-art", "sprite-sheet": "spritesheet", "spritesheets": "spritesheet", "tilesets": "tileset", "tilemap": "tileset",
    "normalmap": "normal-map", "normalmaps": "normal-map", "scifi": "sci-fi", "lowpoly": "low-poly", "topdown": "top-down",
    "gui": "ui", "hud": "ui", "icons": "ui-icon", "char": "character", "chars": "character", "characters": "character",
    "props": "prop", "weapons": "weapon", "textures": "texture", "backgrounds": "background", "bg": "background",
    "portraits": "portrait", "masks": "mask", "animations": "animation", "anim": "animation", "anims": "animation",
    "fx": "vfx", "effects": "vfx", "transparent": "has-alpha",
}
# Namespaces, and the tags of each.
NAMESPACES = ("type", "style", "subject", "source")
VOCABULARY = {
    "type": "tileset character-sprite character ui ui-icon weapon prop vfx portrait background font-atlas normal-map concept-art texture spritesheet mask animation sfx music".split(),
    "style": "pixel-art hand-drawn low-poly flat realistic isometric top-down".split(),
    "subject": "fantasy sci-fi medieval modern nature dungeon town cave".split(),
}
# Words of file names, folders and root folders that say nothing.
NOISE = "final finished copy copie export exported new old untitled default render output out temp tmp test asset assets file image img pic picture the and with for of png jpg jpeg fbx wav ogg".split()
NOISE_FOLDERS = "assets art resources content src source data files out".split()
GENERIC_FOLDERS = "assets out output src content resources data files".split()
# Extensions of each kind.
EXTENSIONS = {
    "image": "png jpg jpeg webp gif bmp tga tif tiff psd exr aseprite ase".split(),
    "model3d": "fbx gltf glb obj stl ply dae blend".split(),
    "audio": "wav ogg mp3 flac aiff aif".split(),
}

# Where words begin in a tag and in a name, and how captions begin that say nothing.
CAMEL = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
WORDS = r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
PREAMBLE = r"(?i)^(the |this )?(image|picture|photo|illustration|artwork|sprite|asset)?\s*(shows|depicts|features|displays|is|contains|presents)\s+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value of a literal map, null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def canonical(c: str | Column) -> Column:
    """A tag in kebab case with aliases resolved; digits start no word."""
    text = F.lower(F.regexp_replace(F.trim(_col(c)), CAMEL, "-"))
    text = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(lookup(ALIASES, text), text)


def namespace_of(tag: Column) -> Column:
    """The namespace that the vocabulary gives a canonical tag, or null."""
    return lookup({t: n for n, tags in VOCABULARY.items() for t in tags}, tag)


def resolve(c: str | Column) -> Column:
    """struct(tag, namespace): a known ``namespace:`` prefix is taken off, an unknown one stays in the name."""
    raw = _col(c)
    head, tail = F.split_part(raw, F.lit(":"), F.lit(1)), F.regexp_replace(raw, "^[^:]*:", "")
    prefixed = F.contains(raw, F.lit(":")) & canonical(head).isin(*NAMESPACES) & (F.trim(tail) != "")
    plain = canonical(raw)
    return F.struct(F.when(prefixed, canonical(tail)).otherwise(plain).alias("tag"), F.when(prefixed, canonical(head)).otherwise(namespace_of(plain)).alias("namespace"))


def words(c: str | Column) -> Column:
    """Content words of a text, canonical, in order and once each."""
    found = F.transform(F.split(_col(c), WORDS), lambda x: F.regexp_replace(canonical(x), "[0-9]+$", ""))
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 2) & ~x.isin(*NOISE) & ~x.rlike("^v[0-9]+$")))


def stem(c: str | Column) -> Column:
    """A file name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(_col(c), r"(?<=.)\.[^.]+$", "")


def name_words(c: str | Column) -> Column:
    """Content words of a file name."""
    return words(stem(c))


def title_tags(c: str | Column, limit: int = 6) -> Column:
    return F.slice(words(c), 1, limit)


def folder_tags(path: str | Column, root: str | Column, depth: int = 2) -> Column:
    """Folders between a file and its root, nearest first, noise left out; ``depth`` counts those kept."""
    below = F.substr(_col(path), F.length(_col(root)) + 2)
    parts = F.split(below, "/")
    folders = F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    tags = F.filter(F.transform(folders, canonical), lambda x: (x != "") & ~x.isin(*NOISE_FOLDERS))
    return F.slice(F.array_distinct(tags), 1, depth)


def root_label(c: str | Column) -> Column:
    """The last part of a path that is not a generic folder name, canonical."""
    parts = F.filter(F.split(_col(c), "/"), lambda x: x != "")
    named = F.filter(parts, lambda x: ~F.lower(x).isin(*GENERIC_FOLDERS))
    return F.coalesce(canonical(F.try_element_at(named, F.lit(-1))), canonical(F.try_element_at(parts, F.lit(-1))), F.lit("root"))


def kind_of(path: str | Column) -> Column:
    """image, model3d or audio by the extension, else null."""
    return lookup({e: k for k, es in EXTENSIONS.items() for e in es}, F.lower(F.regexp_extract(_col(path), r"[^/]\.([A-Za-z0-9]+)$", 1)))


def collapse(c: str | Column, limit: int = 500) -> Column:
    """One line without runs of whitespace, at most ``limit`` characters."""
    return F.substring(F.trim(F.regexp_replace(_col(c), r"\s+", " ")), 1, limit)


_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^#]*)"


def normalise_url(c: str | Column) -> Column:
    """An http(s) address with scheme and host in lower case and no fragment; null if it is none."""
    text = F.trim(_col(c))
    explicit = text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    full = F.when(explicit, text).otherwise(F.concat(F.lit("https://"), text))
    scheme, net = F.lower(F.regexp_extract(full, _URL, 1)), F.lower(F.regexp_extract(full, _URL, 2))
    host = F.regexp_replace(F.regexp_replace(net, "^.*@", ""), ":[0-9]*$", "")
    sound = scheme.isin("http", "https") & host.rlike(r"^[\p{L}\p{N}]([\p{L}\p{N}_.-]*[\p{L}\p{N}])?$") & (explicit | F.contains(host, F.lit(".")))
    return F.when(sound, F.concat(scheme, F.lit("://"), net, F.regexp_extract(full, _URL, 3)))


def host_of(c: str | Column) -> Column:
    """The host of an address without user, port and www."""
    net = F.lower(F.regexp_extract(_col(c), _URL, 2))
    return F.regexp_replace(F.split_part(F.regexp_replace(net, "^.*@", ""), F.lit(":"), F.lit(1)), r"^www\.", "")


def slug_title(c: str | Column) -> Column:
    """The last segment of an address as words, or the host."""
    path = F.regexp_extract(_col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)", 1)
    last = F.try_element_at(F.filter(F.split(path, "/"), lambda x: (x != "") & (x != ".")), F.lit(-1))
    title = collapse(F.regexp_replace(stem(last), "[-_]", " "))
    return F.coalesce(F.nullif(title, F.lit("")), host_of(c))


def content_key(c: str | Column) -> Column:
    """128 bits of a content's SHA-256, in hex."""
    return F.substring(F.sha2(_col(c).cast("binary"), 256), 1, 32)


def link_key(c: str | Column) -> Column:
    """The identity of a link: a key of its normalised address."""
    return content_key(F.concat(F.lit("link:"), normalise_url(c)))


def shard_path(c: str | Column, suffix: str = ".webp") -> Column:
    """ab/cd/abcd....webp; null for keys of fewer than four characters."""
    key = _col(c)
    return F.when(F.length(key) >= 4, F.concat(F.concat_ws("/", F.substring(key, 1, 2), F.substring(key, 3, 2), key), F.lit(suffix)))


def tidy(c: str | Column) -> Column:
    """A caption's first two sentences without a preamble, at most 300 characters, first letter in upper case."""
    text = F.trim(F.regexp_replace(_col(c), r"\s+", " "))
    text = F.regexp_replace(text, PREAMBLE, "")
    kept = F.substring(F.trim(F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, 2), " ")), 1, 300)
    return F.concat(F.upper(F.substring(kept, 1, 1)), F.substr(kept, F.lit(2)))


def next_name(c: str | Column) -> Column:
    """x.png, x-1.png, x-2.png: the next free name to try."""
    name = _col(c)
    dotted = name.rlike(r"^.+\.[^.]*$")
    base = F.when(dotted, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    number = F.regexp_extract(base, r"^.*-([0-9]+)$", 1)
    raised = F.concat(F.regexp_replace(base, "[0-9]+$", ""), (number.try_cast("bigint") + 1).cast("string"))
    after = F.when(number != "", raised).otherwise(F.concat(base, F.lit("-1")))
    return F.concat(after, F.when(dotted, F.regexp_extract(name, r"(\.[^.]*)$", 1)).otherwise(""))


def safe_relative(c: str | Column) -> Column:
    """An untrusted name made safe to join onto a folder."""
    text = F.regexp_replace(_col(c), r"\\", "/")
    text = F.regexp_replace(text, r"^(/+|[A-Za-z]:(/+|$))+", "")
    parts = F.filter(F.split(text, "/"), lambda x: (x != "") & (x != ".") & (x != ".."))
    # drives may come to the front once dots are gone
    drive = lambda x: x.rlike("^[A-Za-z]:$")
    parts = F.filter(parts, lambda x, i: ~(drive(x) & F.forall(F.slice(parts, F.lit(1), i + 1), drive)))
    cleaned = F.array_join(F.transform(parts, lambda x: F.coalesce(F.nullif(F.regexp_replace(x, r"^\.+", ""), F.lit("")), F.lit("_"))), "/")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("upload"))
