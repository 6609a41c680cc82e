"""Vehicle bus lines, frames and readings as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import hex_bytes

# How a battery of wheel readings may spread and jump, and the noise and errors that an adapter prints.
MAX_MPS, SPREAD_MPS, SPREAD_SHARE = 300 / 3.6, 3 / 3.6, 0.5
NOISE = r"(?i)^(?:SEARCHING\.*|BUS INIT:?\s*\.*\s*(?:OK)?)$"
ERRORS = {
    "no-data": r"(?i)^NO DATA$", "unable-to-connect": r"(?i)UNABLE TO CONNECT", "stopped": r"(?i)^STOPPED$", "buffer-full": r"(?i)^BUFFER FULL$", "unknown-command": r"^\?$",
    "bus-error": r"(?i)CAN ERROR|BUS ERROR|BUS BUSY|FB ERROR|DATA ERROR|<RX ERROR|^ERR[0-9][0-9]|BUS INIT:.*ERROR|^LV RESET$|^ACT ALERT$",
}


def lines(raw: Column) -> Column:
    """The non-empty lines of a reply, without prompts and null bytes."""
    clean = F.transform(F.split(F.regexp_replace(raw, r"\x00", ""), r"[\r\n]+"), lambda s: F.trim(F.replace(s, F.lit(">"), F.lit(""))))
    return F.filter(clean, lambda s: s != "")


def reply(command: Column, raw: Column) -> Column:
    """A struct of status and data lines: the echo and noise go, an error counts if no data came."""
    flat = lambda s: F.upper(F.regexp_replace(s, r"\s+", ""))
    rows = lines(raw)
    rows = F.when((F.size(rows) > 0) & (flat(F.get(rows, F.lit(0))) == flat(command)), F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1)))).otherwise(rows)
    rows = F.filter(rows, lambda s: ~s.rlike(NOISE))

    def name(s):
        out = F
        for k, p in ERRORS.items():
            out = out.when(s.rlike(p), k)
        return out.otherwise(None)

    data, errors = F.filter(rows, lambda s: name(s).isNull()), F.filter(F.transform(rows, name), lambda s: s.isNotNull())
    failed = (F.size(data) == 0) & (F.size(errors) > 0)
    return F.struct(F.when(failed, F.get(errors, F.lit(0))).otherwise("ok").alias("status"), F.when(failed, rows).otherwise(data).alias("lines"))


def mode01(line: Column, pid: int, count: int) -> Column:
    """The data bytes of an answer to a mode 01 request, behind no header, 11-bit, 29-bit or three-byte headers; null if it is none."""
    flat, marker = F.upper(F.regexp_replace(line, r"\s+", "")), f"41{pid:02X}"
    at = [F.when((F.length(flat) >= skip + 4 + 2 * count) & (F.substring(flat, skip + 1, 4) == marker), F.substring(flat, skip + 5, 2 * count)) for skip in (0, 5, 10, 6)]
    return F.when(flat.rlike("^[0-9A-F]+$"), hex_bytes(F.coalesce(*at)))


def pid_value(pid: Column, data: Column) -> Column:
    """Speed in m/s (13) and revolutions a minute (12); null for other readings."""
    byte = lambda i: F.get(data, F.lit(i))
    return F.when(pid == 13, byte(0) / 3.6).when(pid == 12, (byte(0) * 256 + byte(1)) / 4)


def supported(base: int, data: Column) -> Column:
    """The two-digit hexadecimal numbers whose bit is set in a bitmap of 32, from base + 1 on."""
    numbers = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.coalesce(F.get(data, F.floor(i / 8).cast("int")).bitwiseAND(F.pow(F.lit(2), 7 - i % 8).cast("int")), F.lit(0)) != 0)
    return F.transform(numbers, lambda i: F.lpad(F.hex(i + base + 1), 2, "0"))


def voltage(line: Column) -> Column:
    return F.regexp_extract(line, r"(?i)([0-9]{1,2}(?:\.[0-9]+)?)\s*V", 1).try_cast("double")


def monitor_line(line: Column, digits: int) -> Column:
    """A struct of id and data bytes of a frame line with an id of 3 or 8 digits; null if it is none."""
    flat = F.upper(F.regexp_replace(line, r"\s+", ""))
    rest = F.substring(flat, digits + 1, 64)
    ok = flat.rlike(f"^[0-9A-F]{{{digits}}}(?:[0-9A-F]{{2}}){{0,8}}$")
    data = F.transform(F.regexp_extract_all(rest, F.lit("[0-9A-F]{2}"), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))
    return F.when(ok, F.struct(F.conv(F.substring(flat, 1, digits), 16, 10).cast("long").alias("id"), data.alias("data")))


def hex_ids(text: Column) -> Column:
    """Distinct ids as typed in hexadecimal between spaces, commas and semicolons; null if one of them is none."""
    parts = F.transform(F.filter(F.split(text, r"[\s,;]+"), lambda p: p != ""), lambda p: F.regexp_replace(p, "(?i)^0x", ""))
    ok = (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike("^[0-9A-Fa-f]{1,8}$"))
    return F.when(ok, F.array_distinct(F.transform(parts, lambda p: F.conv(p, 16, 10).cast("long"))))


def in_slice(id_: Column, prefix: Column | int, bits: int, width: int) -> Column:
    """Whether the top bits of an id of this width are the prefix."""
    return F.shiftright(id_, width - bits) == prefix


def plausible(wheels: Column) -> Column:
    """Whether wheel speeds in m/s are within range and agree: their spread is at most a little and half of the mean."""
    a = F.transform(wheels, F.abs)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (x <= MAX_MPS)) & (F.array_max(a) - F.array_min(a) <= SPREAD_MPS + SPREAD_SHARE * mean)


def wheel_yaw(rear_left: Column, rear_right: Column, track: float, reverse: Column) -> Column:
    """Turn rate in rad/s, to the left positive, from the rear wheels; the other way round in reverse."""
    yaw = (rear_right - rear_left) / track
    return F.when(reverse, -yaw).otherwise(yaw)
