"""Crawl configuration: defaults, merging, exact validation, redaction and fingerprints."""

from __future__ import annotations

import copy
import hashlib
import json

# Defaults of the crawl settings.
DEFAULTS: dict = {
    "seeds": [],
    "scope": {"mode": "origin", "maxUrlLength": 2048, "maxPathSegments": 20, "maxQueryParams": 20, "maxUrlsPerDirectory": 10000, "maxUrlsPerPathPattern": 10000, "include": [], "exclude": [], "allowedHosts": [], "deniedHosts": []},
    "limits": {"maxScheduled": 1000, "maxFetched": 1000, "maxDepth": 5, "maxDurationMs": 1_800_000, "maxQueueSize": 100_000, "maxLinksPerPage": 1000, "maxTotalBytes": 1 << 30},
    "networkSafety": {"enabled": True, "allowPrivate": False, "allowLocalhost": False, "mixedDns": "reject-host"},
    "robots": {"enabled": True, "on4xx": "allow", "on5xx": "disallow", "onNetworkError": "disallow", "respectCrawlDelay": False, "maxBytes": 524_288, "ttlMs": 86_400_000},
    "sitemaps": {"enabled": True, "fromRobots": True, "usualPath": True, "enqueue": True, "maxFiles": 1000, "maxEntriesPerSitemap": 50_000, "maxEntries": 1_000_000, "maxIndexDepth": 5},
    "feeds": {"enabled": False, "discoverFromHtml": True, "enqueue": False},
    "jsDiscovery": {"enabled": False, "mode": "hybrid", "maxBytes": 2_097_152, "maxUrls": 500},
    "cssDiscovery": {"enabled": False, "maxBytes": 2_097_152, "maxUrls": 500},
    "network": {"concurrency": 8, "perOrigin": 2, "maxRedirects": 10, "maxRetries": 2, "retryBackoffMs": 1000, "throttle": {"startDelayMs": 100, "maxDelayMs": 30_000, "smoothing": 0.3}},
    "response": {"maxWireBytes": 5_242_880, "maxDecodedBytes": 10_485_760, "spillBytes": 1_048_576},
    "parsing": {"html": {"maxInputBytes": 5_242_880, "maxNodes": 200_000, "maxDepth": 512, "maxTextBytes": 1_000_000}, "xml": {"maxInputBytes": 5_242_880, "maxNodes": 200_000, "maxDepth": 256}},
    "rendering": {"mode": "never", "minTextBytes": 200},
    "storage": {"type": "sqlite", "frontierOrder": "priority", "leaseMs": 60_000, "renewMs": 20_000, "staleLockMs": 120_000, "rawSnapshots": False, "ndjson": True, "bufferRecords": 100},
    "session": {"headers": {}, "bearer": None, "basic": None},
    "output": {"skipped": True, "summary": True, "hashes": True},
}
SECRET = {"bearer", "basic", "password", "token", "cookie", "authorization"}
# Settings that a resumed run may change.
OPERATIONAL = [("network", "concurrency"), ("network", "perOrigin"), ("limits", "maxDurationMs"), ("storage", "bufferRecords"), ("output",)]
CHOICES = {("scope", "mode"): ["origin", "host", "domain", "custom"], ("rendering", "mode"): ["never", "auto", "always"], ("storage", "type"): ["memory", "filesystem", "sqlite"], ("storage", "frontierOrder"): ["priority", "bfs", "dfs"], ("jsDiscovery", "mode"): ["regex", "ast", "hybrid"]}


class ConfigError(ValueError):
    """A configuration that can't be used; the message names the path."""


def resolve(given: dict) -> dict:
    """Defaults with the given values; unknown keys, wrong types and bad values are refused."""
    out = copy.deepcopy(DEFAULTS)
    _merge(out, given, ())
    _check(out)
    return out


def _merge(into: dict, given: dict, path: tuple[str, ...]) -> None:
    if not isinstance(given, dict):
        raise ConfigError(f"{'.'.join(path) or 'config'} must be an object")
    for key, value in given.items():
        here = (*path, key)
        if key not in into and path != ("session", "headers"):
            raise ConfigError(f"unknown setting {'.'.join(here)}")
        default = into.get(key)
        if isinstance(default, dict):
            _merge(default, value, here)
            continue
        if default is not None and not (isinstance(value, type(default)) or isinstance(default, float) and isinstance(value, int)) or isinstance(value, bool) != isinstance(default, bool) and default is not None:
            raise ConfigError(f"{'.'.join(here)} must be {type(default).__name__}")
        into[key] = copy.deepcopy(value)


def _check(config: dict) -> None:
    for (section, key), allowed in CHOICES.items():
        if config[section][key] not in allowed:
            raise ConfigError(f"{section}.{key} must be one of {', '.join(allowed)}")

    def numbers(node: dict, path: tuple[str, ...]) -> None:
        for k, v in node.items():
            if isinstance(v, dict):
                numbers(v, (*path, k))
            elif isinstance(v, int | float) and not isinstance(v, bool) and v < 0:
                raise ConfigError(f"{'.'.join((*path, k))} must not be negative")

    numbers(config, ())
    if not 0 <= config["network"]["throttle"]["smoothing"] <= 1:
        raise ConfigError("network.throttle.smoothing must lie between 0 and 1")
    if config["storage"]["renewMs"] >= config["storage"]["leaseMs"]:
        raise ConfigError("storage.renewMs must be below storage.leaseMs")
    if config["network"]["perOrigin"] > config["network"]["concurrency"]:
        raise ConfigError("network.perOrigin must not exceed network.concurrency")


def redact(config: dict) -> dict:
    """The configuration without secrets, for storage."""
    out = copy.deepcopy(config)

    def walk(node: dict, hidden: bool) -> None:
        for k, v in node.items():
            if isinstance(v, dict):
                walk(v, hidden or k == "headers")
            elif v is not None and (hidden or k.lower() in SECRET):
                node[k] = "[redacted]"

    walk(out, False)
    return out


def fingerprints(config: dict) -> dict[str, str]:
    """Hashes of the whole configuration and of what a resumed run must share."""
    neutral = copy.deepcopy(config)
    for path in OPERATIONAL:
        node = neutral
        for k in path[:-1]:
            node = node[k]
        node[path[-1]] = None
    digest = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return {"exact": digest(config), "resume": digest(neutral)}


def frontier_backend(config: dict) -> str:
    return {"memory": "memory", "filesystem": "journal", "sqlite": "sqlite"}[config["storage"]["type"]]
