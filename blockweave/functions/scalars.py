"""Scalar functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of sizes, as powers of ten and of two.
TENS = {"": 0, "B": 0, "K": 3, "KB": 3, "M": 6, "MB": 6, "G": 9, "GB": 9, "T": 12, "TB": 12, "P": 15, "PB": 15, "E": 18, "EB": 18}
TWOS = {"KIB": 10, "MIB": 20, "GIB": 30, "TIB": 40, "PIB": 50, "EIB": 60}
_NUMBER = r"^([0-9]+\.?[0-9]*|\.[0-9]+)"


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def parse_size_unsigned(text: Column) -> Column:
    """Bytes, as DECIMAL(20,0), of a size with a unit in any case and spaces anywhere; null for what isn't one, has part of a byte or passes 2**64 - 1.

    Exact: of a number with d decimals (without zeros at the end, at most 38),
    10**k has whole bytes if d <= k, and 2**k if moreover 5**d divides the
    decimals.
    """
    t = F.upper(F.regexp_replace(F.trim(text), " ", ""))
    number, unit = F.regexp_extract(t, _NUMBER + "([A-Z]*)$", 1), F.regexp_extract(t, _NUMBER + "([A-Z]*)$", 2)
    whole = F.coalesce(F.substring_index(number, ".", 1).try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    part = F.regexp_replace(F.regexp_extract(number, r"\.([0-9]*)$", 1), "0+$", "")
    d, tens, twos = F.length(part), _map(TENS)[unit], _map(TWOS)[unit]
    digits = F.coalesce(part.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    fives = F.try_element_at(F.array(*(F.lit(str(5**i)).cast("decimal(38,0)") for i in range(39))), d + 1)
    power = F.element_at(F.array(*(F.lit(str(2**i)).cast("decimal(20,0)") for i in range(61))), F.coalesce(twos, F.lit(0)) + 1)
    shift = F.try_element_at(F.array(*(F.lit(str(2**i)).cast("decimal(20,0)") for i in range(61))), F.greatest(F.coalesce(twos, F.lit(0)) - d, F.lit(0)) + 1)
    by_ten = F.concat(whole.cast("string"), F.rpad(part, tens, "0")).try_cast("decimal(38,0)")
    quotient = F.when(digits % fives == 0, F.call_function("div", digits, fives))
    by_two = (whole * power + quotient.cast("decimal(18,0)") * shift).try_cast("decimal(38,0)")
    n = F.when(tens.isNotNull() & (d <= tens), by_ten).when(twos.isNotNull() & (d <= twos), by_two)
    return F.when((number != "") & (F.length(F.regexp_replace(F.substring_index(number, ".", 1), "^0+", "")) <= 20) & (n <= F.lit(str(2**64 - 1)).cast("decimal(20,0)")), n.try_cast("decimal(20,0)"))


def parse_size(text: Column) -> Column:
    """The same as LONG; null past 2**63 - 1 too. Percents: see parse_percent."""
    return parse_size_unsigned(text).try_cast("long")


def parse_percent(text: Column) -> Column:
    """The whole percent of "50%", "50.0 %"; null for others."""
    t = F.trim(text)
    number = F.regexp_extract(t, r"^([0-9]+)(?:\.0*)? *%$", 1)
    return F.when(number != "", number.try_cast("long"))


def format_bytes(n: Column, units: str = "kMGTPE") -> Column:
    """1000-based, one decimal from kB on; what passes the last unit stays in it."""
    out = F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B")))
    for i, u in enumerate(units, 1):
        out = out.when((n < 1000 ** (i + 1)) if i < len(units) else F.lit(True), F.concat(one_decimal(n / float(1000**i)), F.lit(f" {u}B")))
    return out


def one_decimal(x: Column) -> Column:
    """A double from 1 to 2**53 with one decimal, rounded as C does: by its exact value, ties to even. The fraction of such a number is a whole number of 2**-52."""
    bits, half = F.lit(1 << 52), 1 << 51
    tenths = ((x - F.floor(x)) * float(1 << 52)).cast("long") * 10
    digit, rest = F.call_function("div", tenths, bits), tenths % bits
    digit = digit + ((rest > half) | ((rest == half) & (digit % 2 == 1))).cast("long")
    return F.concat((F.floor(x) + F.when(digit == 10, 1).otherwise(0)).cast("string"), F.lit("."), (digit % 10).cast("string"))


def negotiate(local: list[str], remote: Column, fallback: bool = False) -> Column:
    """The first local choice that the other side has; null, or the first local one, if none."""
    got = F.try_element_at(F.array_intersect(F.array(*map(F.lit, local)), remote), F.lit(1))
    return F.coalesce(got, F.lit(local[0])) if fallback else got


def tolerant_equal(a: Column, b: Column) -> Column:
    """Equal, or unknown on either side (null, empty or 0)."""
    known = lambda c: c.isNotNull() & ~c.cast("string").isin("", "0")
    return ~known(a) | ~known(b) | (a == b)


def choose_codec(size: Column, simd: bool = True, level: int = 3) -> Column:
    """Small chunks: lz4; else zstd with its level held between 1 and 3, if vector instructions are there."""
    return F.when(size < 256 * 1024, F.lit("lz4")).otherwise(F.lit(f"zstd:{min(3, max(1, level))}" if simd else "lz4"))


def transfer_estimate(size: Column, speed: Column) -> tuple[Column, Column]:
    """(milliseconds of whole seconds, bits a second)."""
    return (F.floor(size / speed) * 1000).cast("long"), (speed * 8).cast("long")


def max_chunks(ram: Column, fp: Column) -> Column:
    """How many chunks a filter of this error fits into memory."""
    return F.floor(ram * 0.4809 / F.log(1 / fp)).cast("long")


def adaptive_chunk(size: Column, ram: Column, fp: Column, low: int, high: int) -> Column:
    n = F.greatest(F.lit(1), max_chunks(ram, fp))
    return F.least(F.lit(high), F.greatest(F.lit(low), F.floor(size / n))).cast("long")


def choose_strategy(size: Column, ram: Column, fp: Column, simd: bool = True) -> Column:
    """bloom if the filter holds a chunk for each 4 KiB, else the checksum or the rolling hash."""
    return F.when(max_chunks(ram, fp) >= F.greatest(F.lit(1), F.floor(size / 4096)), F.lit("bloom")).otherwise(F.lit("checksum" if simd else "rolling_hash"))


def first_block_size(*choices: Column) -> Column:
    """The first above 0, else 4096."""
    return F.coalesce(*(F.when(c > 0, c) for c in choices), F.lit(4096))


def mbr_signature(raw: Column) -> Column:
    """The disk signature in a volume's first sector, as eight hex digits; null without the sector's mark."""
    return F.when(F.hex(F.substring(raw, 511, 2)) == "55AA", F.lower(F.concat(*(F.hex(F.substring(raw, i, 1)) for i in (444, 443, 442, 441)))))


def gpt_guid(raw: Column) -> Column:
    """The disk GUID in a volume's second sector; null without its header."""
    return F.when(F.hex(F.substring(raw, 513, 8)) == "4546492050415254", guid(F.substring(raw, 569, 16)))


def gcd(a: Column, b: Column) -> Column:
    """By folding Euclid's step over a bounded number of rounds (at most 90 for 64 bits)."""
    pair = F.aggregate(F.sequence(F.lit(1), F.lit(90)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b"))))
    return pair["a"]


def cpu_list(text: Column) -> Column:
    """"0-3,8" as an array of numbers."""
    part = F.filter(F.split(text, ","), lambda p: p != "")
    low, high = lambda p: F.split(p, "-")[0].cast("int"), lambda p: F.element_at(F.split(p, "-"), -1).cast("int")
    return F.flatten(F.transform(part, lambda p: F.sequence(low(p), high(p))))


def guid(raw: Column) -> Column:
    """The text form of 16 bytes whose first three fields are little-endian."""
    h = F.lower(F.hex(raw))
    byte = lambda *at: F.concat(*(F.substr(h, F.lit(2 * i + 1), F.lit(2)) for i in at))
    return F.concat_ws("-", byte(3, 2, 1, 0), byte(5, 4), byte(7, 6), byte(8, 9), byte(10, 11, 12, 13, 14, 15))


# The tokens of a handshake line, in the order in which they are written; numbers, words, lists, marks.
HANDSHAKE = (
    ("endian", "word"), ("block", "number"), ("dedup", "word"), ("resume", "word"), ("odirect", "mark"), ("inflight", "number"), ("cdcmin", "number"), ("cdcavg", "number"), ("cdcmax", "number"), ("alpn", "word"), ("tls", "word"),
    ("transports", "list"), ("compressors", "list"), ("digests", "list"), ("crc32c", "mark"), ("checksum", "mark"), ("checksum-dedup", "mark"), ("transport", "word"), ("compress", "word"), ("digest", "word"), ("level", "number"),
)
KIND = dict(HANDSHAKE)


def parse_handshake(line: Column, version: str) -> Column:
    """A struct of all HANDSHAKE fields (dashes as underscores) and ``problem``: "protocol" for a line of another version, or the first field whose number isn't one. Unknown tokens are ignored; of repeated ones the last counts; compress is "none" if absent."""
    # All tokens between single spaces and with a colon, so that the last of a name is found in one pass over the line.
    spaced = F.regexp_replace(F.concat(F.lit(" "), F.substr(F.trim(line), F.lit(len(version) + 1)), F.lit(" ")), r"\s+", " ")
    tokens = F.coalesce(F.regexp_replace(spaced, "(?<= )([^ :]+)(?= )", "$1:"), F.lit(""))
    last = lambda t, name: F.when(F.contains(t, F.lit(f" {name}:")), F.substring_index(F.substring_index(t, f" {name}:", -1), " ", 1)).alias(name)
    values = let(tokens, lambda t: F.struct(*(last(t, name) for name, _ in HANDSHAKE)))
    return let(values, lambda m: _handshake(m, F.when(~F.startswith(F.trim(line), F.lit(version)), F.lit("protocol"))))


def _handshake(m: Column, bad: Column) -> Column:
    out = []
    for name, kind in HANDSHAKE:
        v = m[name]
        if kind == "number":
            bad = bad.when(v.isNotNull() & v.try_cast("long").isNull(), F.lit(name))
            v = F.coalesce(v.try_cast("long"), F.lit(0))
        elif kind == "mark":
            v = v.isNotNull()
            v = (v | m["checksum-dedup"].isNotNull()) if name == "checksum" else v
        elif kind == "list":
            v = F.filter(F.split(F.coalesce(v, F.lit("")), ","), lambda x: F.trim(x) != "")
        else:
            v = F.coalesce(v, F.lit("none" if name == "compress" else ""))
            v = F.when(v == "", F.lit("none")).otherwise(v) if name == "compress" else v
        out.append(v.alias(name.replace("-", "_")))
    return F.struct(*out, bad.alias("problem"))


def tokens_last(line: Column) -> Column:
    """The tokens of a line as a map; of repeated keys the last."""
    pairs = F.transform(F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != ""), lambda t: F.struct(F.split(t, ":", 2)[0].alias("k"), F.coalesce(F.get(F.split(t, ":", 2), F.lit(1)), F.lit("")).alias("v")))
    keep = lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda y: y["k"] == x["k"])
    return F.map_from_entries(F.filter(pairs, keep))


def format_handshake(h: Column, version: str) -> Column:
    """The line of a handshake struct; fields that are unset are left out, checksum-dedup stands for checksum."""
    out = [F.lit(version)]
    for name, kind in HANDSHAKE:
        v = h[name.replace("-", "_")]
        if kind == "mark":
            shown = F.when(v & (~h["checksum_dedup"] if name == "checksum" else F.lit(True)), F.lit(name))
        elif kind == "list":
            shown = F.when(F.size(v) > 0, F.concat(F.lit(f"{name}:"), F.array_join(v, ",")))
        elif kind == "number":
            shown = F.when(v != 0 if name == "level" else v > 0, F.concat(F.lit(f"{name}:"), v.cast("string")))
        elif name == "compress":
            shown = F.concat(F.lit("compress:"), F.when(v == "", F.lit("none")).otherwise(v))
        else:
            shown = F.when(v != "", F.concat(F.lit(f"{name}:"), v))
        out.append(shown)
    return F.concat_ws(" ", *out)


# What two handshakes must agree on, in the order in which it is checked.
AGREE = ("endian", "block", "dedup", "cdcmin", "cdcavg", "cdcmax", "compress", "level", "digest", "crc32c", "odirect", "resume", "inflight", "transport", "alpn", "tls")


def handshake_failure(local: Column, peer: Column) -> Column:
    """The first thing in which two handshakes can't work together: "local cdc order", "peer cdc order", or the name of a field that both set and set differently; marks must be equal. Null if there is none."""
    out = None
    for side, h in (("local", local), ("peer", peer)):
        sizes = [h[f"cdc{x}"] for x in ("min", "avg", "max")]
        bad = (F.least(*sizes) > 0) & ~((sizes[0] <= sizes[1]) & (sizes[1] <= sizes[2]))
        out = F.when(bad, f"{side} cdc order") if out is None else out.when(bad, f"{side} cdc order")
    for name in AGREE:
        a, b, kind = local[name], peer[name], KIND[name]
        set_ = F.lit(True) if kind == "mark" else (a != "") & (b != "") if kind == "word" else (a != 0) & (b != 0) if name == "level" else (a > 0) & (b > 0)
        out = out.when(set_ & (a != b), F.lit(name))
    return out


def select_best(local: Column, remote: Column) -> Column:
    """The first of a list that is in the other; else the first; empty of an empty list."""
    return F.coalesce(F.try_element_at(F.array_intersect(local, remote), F.lit(1)), F.get(local, F.lit(0)), F.lit(""))


def merge_handshake(local: Column, peer: Column) -> Column:
    """local with transport, compress and digest, where they are unset, chosen from its own lists by what the peer has."""
    out = local
    for one, many in (("transport", "transports"), ("compress", "compressors"), ("digest", "digests")):
        best = select_best(local[many], F.concat(peer[many], F.array(peer[one])))
        out = out.withField(one, F.when(local[one] == "", best).otherwise(local[one]))
    return out


def compression_plan(c: Column, simd: bool = True) -> Column:
    """A map from "min", "avg", "max" or "block" to struct(chunk_size, algorithm, level) for a struct of settings (dedup_mode, block_size, cdc_min, cdc_avg, cdc_max, compress, lz4_level, zstd_level). Sizes that aren't above 0 are left out."""
    lz4 = F.when(F.lower(F.coalesce(c["lz4_level"], F.lit(""))) == "hc", F.lit(9)).otherwise(F.lit(1))
    zstd = F.coalesce(c["zstd_level"], F.lit(0))
    fast = F.struct(F.lit("lz4").alias("algorithm"), lz4.alias("level"))
    auto = F.coalesce(c["compress"], F.lit("")).isin("", "auto")

    def choose(size):
        level = F.when(zstd <= 0, F.lit(3)).otherwise(F.least(zstd, F.lit(3)))
        free = F.when(size < 256 * 1024, fast).otherwise(F.struct(F.lit("zstd").alias("algorithm"), level.alias("level")) if simd else fast)
        fixed = F.when(c["compress"] == "zstd", F.struct(F.lit("zstd").alias("algorithm"), F.when(zstd == 0, F.lit(3)).otherwise(zstd).alias("level"))).otherwise(F.struct(c["compress"].alias("algorithm"), lz4.alias("level")))
        return F.when(auto, free).otherwise(fixed)

    def entry(name, size):
        how = choose(size)
        return F.struct(F.lit(name).alias("k"), F.struct(size.cast("long").alias("chunk_size"), how["algorithm"].alias("algorithm"), how["level"].cast("int").alias("level")).alias("v"))

    cut = F.filter(F.array(*(entry(n, c[f"cdc_{n}"]) for n in ("min", "avg", "max"))), lambda e: e["v"]["chunk_size"] > 0)
    whole = F.filter(F.array(entry("block", c["block_size"])), lambda e: e["v"]["chunk_size"] > 0)
    return F.map_from_entries(F.when(c["dedup_mode"].isin("cdc", "hybrid"), cut).otherwise(whole))


def hash_algorithm(name: Column, strict: bool = False, simd: bool = True) -> Column:
    """blake3 or sha256; auto or nothing goes by what the processor has, and unknown names mean sha256, or null if strict."""
    n = F.lower(F.coalesce(name, F.lit("")))
    known = n.isin("blake3") if strict else n.isin("blake3", "blake3-256")
    out = F.when(n.isin("", "auto"), F.lit("blake3" if simd else "sha256")).when(known, F.lit("blake3")).when(n == "sha256", F.lit("sha256"))
    return out if strict else F.coalesce(out, F.lit("sha256"))


def dedup_strategy(name: Column, simd: bool = True) -> Column:
    """none, checksum, rolling_hash or bloom; auto goes by what the processor has, and unknown names mean checksum."""
    return F.when(name == "auto", F.lit("checksum" if simd else "rolling_hash")).when(name.isin("none", "rolling_hash", "bloom"), name).otherwise(F.lit("checksum"))


def redact(df, names: list[str]):
    """df with the named columns blank."""
    return df.withColumns({n: F.lit("") for n in names if n in df.columns})


def within(path: Column, root: Column) -> Column:
    """A path is the root or below it."""
    r = F.regexp_replace(root, "/+$", "")
    return (path == r) | F.startswith(path, F.concat(r, F.lit("/")))


def snapshot_size(text: Column, volume: Column) -> Column:
    """Bytes of a snapshot: a size, or 1 to 100 percent of the volume where that is a whole number; null for others."""
    p = parse_percent(text)
    share = volume.cast("decimal(20,0)") * p
    return F.when(p.isNull(), parse_size(text)).when(p.between(1, 100) & (share % 100 == 0), (share / 100).cast("long"))


def lv_path(path: Column) -> Column:
    """struct(vg, lv) of a volume's path; a mapper name has its own dashes doubled and parts at the first single one. Null if either is empty."""
    clean = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "(.)/$", "$1")
    base, single = F.substring_index(clean, "/", -1), F.lit("\x01")
    held = F.replace(base, F.lit("--"), single)
    cut = F.instr(held, "-")
    whole = lambda c: F.replace(c, single, F.lit("-"))
    mapped = F.contains(clean, F.lit("/mapper/"))
    vg = F.when(mapped, F.when(cut > 0, whole(F.substring_index(held, "-", 1)))).otherwise(F.substring_index(F.substring_index(clean, "/", -2), "/", 1))
    lv = F.when(mapped, whole(F.substr(held, cut + 1))).otherwise(base)
    return F.when((vg != "") & (lv != ""), F.struct(vg.alias("vg"), lv.alias("lv")))


def partition_line(line: Column) -> Column:
    """struct(start, end, type) of a partition's line in the dump of a table, "device : key=value, ..." with its keys in any order, end inclusive; of repeated keys the last counts; null for comments and lines that lack one of start, size and type."""
    t = F.trim(line)
    pairs = F.transform(F.split(F.substr(t, F.instr(t, " : ") + 3), ","), lambda x: F.split(F.trim(x), "=", 2))
    last = lambda key: F.trim(F.try_element_at(F.filter(pairs, lambda x: (F.size(x) == 2) & (F.trim(x[0]) == key)), F.lit(-1))[1])
    start, size, kind = last("start").try_cast("long"), last("size").try_cast("long"), last("type")
    ok = F.startswith(t, F.lit("/")) & (F.instr(t, " : ") > 0) & start.isNotNull() & size.isNotNull() & (kind != "")
    return F.when(ok, F.struct(start.alias("start"), (start + size - 1).alias("end"), kind.alias("type")))


def has_option(options: Column, name: str) -> Column:
    return F.array_contains(F.split(options, ","), name)
