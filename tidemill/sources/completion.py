"""A client for chat completions over HTTP, for use inside tasks. Nothing beyond the standard library is needed."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from dataclasses import dataclass


@dataclass(frozen=True)
class HttpClient:
    """Asks a server that speaks the common chat-completions form: messages in, choices out. Busy and failing servers are asked again.

    Pass functools.partial(HttpClient, url, model, key) to toolrows.complete; the key is an argument, never read from the environment."""

    url: str
    model: str
    key: str = ""
    timeout: float = 60.0
    tries: int = 3
    wait: float = 1.0
    temperature: float = 0.7

    def complete(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "temperature": self.temperature, "messages": [{"role": "user", "content": prompt}]}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        for attempt in range(self.tries):
            try:
                request = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", body, headers)
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    text = json.load(answer)["choices"][0]["message"]["content"]
                if not isinstance(text, str):
                    raise ValueError("a completion without text")
                return text
            except urllib.error.HTTPError as error:
                if attempt + 1 == self.tries or error.code < 500 and error.code != 429:
                    raise
            except (urllib.error.URLError, TimeoutError):
                if attempt + 1 == self.tries:
                    raise
            time.sleep(self.wait * 2**attempt)
        raise RuntimeError("no tries")
