"""Metadata of images: sizes from their headers, and EXIF, TIFF and GPS fields."""

from __future__ import annotations

import struct

Properties = list[tuple[str, str]]
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
#: Fields that are shown, in order, by tag.
_MAIN = ((0x010F, "Make"), (0x0110, "Model"), (0x013B, "Artist"), (0x8298, "Copyright"), (0x0131, "Software"))
_EXIF, _GPS = 0x8769, 0x8825


def _jpeg(data: bytes) -> tuple[tuple[int, int] | None, bytes | None]:
    at, size, exif = 2, None, None
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9 or marker == 0xDA:
            break
        length = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            height, width = struct.unpack_from(">HH", body, 1)
            size = (width, height)
        if marker == 0xE1 and body.startswith(b"Exif\0\0") and exif is None:
            exif = body[6:]
        at += 2 + max(2, length)
    return size, exif


def _png(data: bytes) -> tuple[tuple[int, int] | None, bytes | None]:
    size = struct.unpack_from(">II", data, 16) if len(data) >= 24 else None
    at, exif = 8, None
    while at + 8 <= len(data):
        length, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"eXIf":
            exif = data[at + 8 : at + 8 + length]
        at += 12 + length
    return size, exif


def _webp(data: bytes) -> tuple[tuple[int, int] | None, bytes | None]:
    at, size, exif = 12, None, None
    while at + 8 <= len(data):
        kind, length = struct.unpack_from("<4sI", data, at)
        body = data[at + 8 : at + 8 + length]
        if kind == b"VP8X" and len(body) >= 10:
            size = (1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little"))
        elif kind == b"VP8 " and len(body) >= 10 and size is None:
            width, height = struct.unpack_from("<HH", body, 6)
            size = (width & 0x3FFF, height & 0x3FFF)
        elif kind == b"VP8L" and len(body) >= 5 and size is None:
            bits = int.from_bytes(body[1:5], "little")
            size = ((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1)
        elif kind == b"EXIF":
            exif = body.removeprefix(b"Exif\0\0")
        at += 8 + length + (length & 1)
    return size, exif


def image_parts(data: bytes) -> tuple[tuple[int, int] | None, bytes | None]:
    """(width, height) and the TIFF block with the metadata, as far as there are any."""
    if data.startswith(b"\xff\xd8\xff"):
        return _jpeg(data)
    if data.startswith(b"\x89PNG"):
        return _png(data)
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack_from("<HH", data, 6), None
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack_from("<ii", data, 18)
        return (width, abs(height)), None
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _webp(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        tags = Tiff(data).directory(None)
        size = (tags.get(0x0100), tags.get(0x0101))
        return (size if all(isinstance(v, int) for v in size) else None), data
    return None, None


class Tiff:
    """Directories of a TIFF block; anything out of place is left out."""

    def __init__(self, data: bytes):
        self.data, self.order = data, "<" if data[:2] == b"II" else ">"

    def directory(self, at: int | None) -> dict[int, object]:
        out: dict[int, object] = {}
        try:
            at = struct.unpack_from(self.order + "I", self.data, 4)[0] if at is None else at
            for k in range(struct.unpack_from(self.order + "H", self.data, at)[0]):
                tag, kind, count = struct.unpack_from(self.order + "HHI", self.data, at + 2 + 12 * k)
                if kind in _SIZES and (value := self._value(kind, count, at + 10 + 12 * k)) is not None:
                    out[tag] = value
        except struct.error:
            pass
        return out

    def _value(self, kind: int, count: int, at: int):
        size = _SIZES[kind] * count
        if size > len(self.data):
            return None
        if size > 4:
            at = struct.unpack_from(self.order + "I", self.data, at)[0]
        raw = self.data[at : at + size]
        if len(raw) < size or not count:
            return None
        if kind == 2:
            return raw.split(b"\0")[0].decode("utf-8", "replace").strip()
        if kind in (1, 7):
            return raw[0] if count == 1 else raw
        if kind in (3, 4, 9):
            values = struct.unpack(f"{self.order}{count}{ {3: 'H', 4: 'I', 9: 'i'}[kind]}", raw)
        else:
            pairs = struct.unpack(f"{self.order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
            values = tuple(a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True))
        return values[0] if count == 1 else values


#: Record and number of the captions that are shown.
_CAPTIONS = (((2, 5), "Title"), ((2, 120), "Description"), ((2, 25), "Keywords"))


def captions(data: bytes) -> Properties:
    """Title, description and keywords from a JPEG's caption block."""
    at = data.find(b"Photoshop 3.0\0") if data.startswith(b"\xff\xd8\xff") else -1
    at = data.find(b"8BIM\x04\x04", at) if at >= 0 else -1
    if at < 0 or at + 12 > len(data):
        return []
    at += 6
    at += (data[at] + 2) // 2 * 2  # a name of even length, its size included
    if at + 4 > len(data):
        return []
    end = at + 4 + struct.unpack_from(">I", data, at)[0]
    at += 4
    found: dict[tuple[int, int], list[str]] = {}
    while at + 5 <= min(end, len(data)) and data[at] == 0x1C:
        record, number, size = struct.unpack_from(">BBH", data, at + 1)
        found.setdefault((record, number), []).append(data[at + 5 : at + 5 + size].decode("utf-8", "replace"))
        at += 5 + size
    return [(name, ", ".join(found[key]) if name == "Keywords" else found[key][0]) for key, name in _CAPTIONS if key in found]


def _degrees(value: object) -> float | None:
    if isinstance(value, tuple) and len(value) == 3:
        return value[0] + value[1] / 60 + value[2] / 3600
    return None


def image_properties(data: bytes) -> Properties:
    """Size, camera, exposure and place, in a fixed order and form."""
    size, block = image_parts(data)
    out: Properties = [("ImageSize", f"{size[0]} × {size[1]}")] if size else []
    if block is None or block[:2] not in (b"II", b"MM"):
        return out + captions(data)
    tiff = Tiff(block)
    main = tiff.directory(None)
    out += [(name, main[tag]) for tag, name in _MAIN if isinstance(main.get(tag), str) and main[tag]]
    exif = tiff.directory(main[_EXIF]) if isinstance(main.get(_EXIF), int) else {}
    gps = tiff.directory(main[_GPS]) if isinstance(main.get(_GPS), int) else {}
    for tag, name in ((0x9003, "DateTimeOriginal"), (0xA434, "LensModel")):
        if isinstance(exif.get(tag), str) and exif[tag]:
            out.append((name, exif[tag]))
    if isinstance(exif.get(0x920A), float):
        out.append(("FocalLength", f"{exif[0x920A]:.1f} mm"))
    if isinstance(exif.get(0x829D), float):
        out.append(("Aperture", f"f/{exif[0x829D]:.1f}"))
    speed = exif.get(0x8827)
    speed = speed[0] if isinstance(speed, tuple) else speed
    if isinstance(speed, int):
        out.append(("ISO", str(speed)))
    time = exif.get(0x829A)
    if isinstance(time, float) and time > 0:
        out.append(("ExposureTime", f"1/{int(1 / time)}s" if time < 1 else f"{time:.1f}s"))
    latitude, longitude = _degrees(gps.get(2)), _degrees(gps.get(4))
    if latitude is not None and longitude is not None and isinstance(gps.get(1), str) and isinstance(gps.get(3), str):
        out.append(("GPSPosition", f"{latitude:.5f}°{gps[1]}, {longitude:.5f}°{gps[3]}"))
    if isinstance(gps.get(6), float):
        out.append(("GPSAltitude", f"{gps[6]:.0f} m"))
    return out + captions(data)


def needs_upscale(width: int, height: int, scale: float, least: int = 1500) -> bool:
    return scale > 1 and max(width, height) < least


def property_table(properties: Properties) -> str:
    if not properties:
        return ""
    return "| Property | Value |\n| --- | --- |\n" + "".join(f"| {k} | {v.replace('|', chr(92) + '|')} |\n" for k, v in properties)

