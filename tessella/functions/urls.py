"""URLs as browsers serialise them."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote, urlencode, urlsplit

# Parameters that only track.
TRACKING = frozenset("fbclid gclid igshid mc_cid mc_eid msclkid".split())


def canonical(url: str) -> str:
    """A URL as a browser serialises it, without fragment and tracking parameters, parameters sorted by name; what isn't a URL stays."""
    try:
        parts = urlsplit(url.strip())
        if parts.scheme.lower() not in ("http", "https") or not parts.hostname:
            return url
        host = parts.hostname.encode("idna").decode() if not parts.hostname.isascii() else parts.hostname
        port = f":{parts.port}" if parts.port and parts.port != {"http": 80, "https": 443}[parts.scheme.lower()] else ""
        login = f"{parts.username or ''}{':' + parts.password if parts.password else ''}@" if parts.username or parts.password else ""
        params = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in TRACKING]
        query = urlencode(sorted(params, key=lambda p: p[0]))
        return f"{parts.scheme.lower()}://{login}{host}{port}{quote(parts.path, safe='/%:@!$&()*+,;=~-._') or '/'}" + (f"?{query}" if query else "")
    except (ValueError, UnicodeError):
        return url
