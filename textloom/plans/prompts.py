"""Prompts and query strings; plain functions on the driver."""

from __future__ import annotations

import json
import time

from textloom.operators.vector import Generator


def load_spec(specs: dict, name: str) -> dict:
    if name not in specs:
        raise KeyError(f"unknown format {name!r}; known: {', '.join(sorted(specs))}")
    return specs[name]


def query_text(topic: str, goal: str, audience: str) -> str:
    return f"{topic}. {goal}. Audience: {audience}."


def persona_query(query: str, profile: dict) -> str:
    """The query with the author's first topics and words."""
    topics = " ".join(profile.get("themes", [])[:4])
    words = " ".join(profile.get("top_words", [])[:15])
    return " ".join(x for x in (query, topics, words) if x)


def summarize(profile: dict) -> str:
    rows = [("Vocabulary", "top_words", 20), ("Sentence openings", "starters", 10), ("Framing", "framing", 10), ("Themes", "themes", 15)]
    return "\n".join(f"{name}: {', '.join(profile[key][:n])}" for name, key, n in rows if profile.get(key))


def describe_spec(spec: dict) -> str:
    out = [f"Type: {spec.get('output_type', 'text')}"]
    if target := spec.get("length_target_words"):
        out.append(f"Length: {target[0]}-{target[1]} words")
    out += [f"{k}: {v}" for k, v in (spec.get("structure") or {}).items()]
    for name, key in (("Avoid", "banned"), ("Style", "style")):
        if spec.get(key):
            out.append(f"{name}: {'; '.join(spec[key])}")
    return "\n".join(out)


def build_prompt(profile: dict, spec: dict, context: str, request: dict) -> str:
    ask = "\n".join(f"{k.capitalize()}: {request[k]}" for k in ("topic", "audience", "goal", "cta") if request.get(k))
    return f"Write in this voice.\n\n{summarize(profile)}\n\nFormat:\n{describe_spec(spec)}\n\nExcerpts:\n{context}\n\nTask:\n{ask}\n"


def format_prompt(topic: str, kind: str, profile: dict, spec: dict, chunks: list[dict], author: str = "the author") -> str:
    """The older form: system, format, context (500 characters of each chunk that has text), request."""
    style, limits = profile.get("style", {}), spec.get("constraints", {})
    joined = lambda xs, sep="; ": sep.join(xs or [])
    system = f"Write in the style of {author}. Use these characteristics: {joined(profile.get('rhetorical_patterns', [])[:4])}. Characteristic vocabulary: {joined(style.get('characteristic_words', [])[:15], ', ')}."
    shape = f"Format: {spec.get('format_name', kind)}. Word count: {limits.get('min_words', 100)}-{limits.get('max_words', 500)}. Structure: {joined(spec.get('structure'))}. Tone: {joined(spec.get('tone'))}. Do NOT use these phrases: {joined(spec.get('prohibited_patterns'), ', ')}."
    context = "\n---\n".join(c["text"][:500] for c in chunks if c.get("text")) or "(no context available)"
    return f"### System:\n{system}\n\n### Format:\n{shape}\n\n### Context (relevant writing from {author}):\n{context}\n\n### Request:\nNow write a {kind.replace('_', ' ')} about: {topic}\n\n### Response:\n"


def repunctuation_prompt(text: str) -> str:
    return f"Restore punctuation and capitals. Keep every word and their order; output only the corrected text.\n\nTranscript to fix:\n<<<\n{text}\n>>>\n\nCorrected:"


def judge_prompt(answer: str, dims: tuple[str, ...], anchor: str = "") -> str:
    shape = json.dumps({d: 0 for d in dims} | {"comment": ""})
    sample = f"A sample of the author:\n{anchor}\n\n" if anchor else ""
    return f"{sample}Rate the text from 1 to 5 on {', '.join(dims)}. Answer with JSON like {shape}.\n\n{answer}"


def generate(generator: Generator, prompt: str, drafts: int = 1, score=None) -> str:
    """The best of some drafts."""
    texts = [generator.generate(prompt) for _ in range(drafts)]
    return max(texts, key=score) if score else texts[0]


def trace(generator: Generator, profile: dict, spec: dict, request: dict, contexts: list[dict]) -> dict:
    """What a request saw and gave, for evaluation; ``contexts`` have ``doc_id``, ``source``, ``text``."""
    query = query_text(request.get("topic", ""), request.get("goal", ""), request.get("audience", ""))
    prompt = build_prompt(profile, spec, "\n\n".join(c["text"] for c in contexts), request)
    began = time.monotonic()
    answer = generate(generator, prompt)
    return request | {
        "query": query, "contexts": [c["text"] for c in contexts], "context_meta": [{"doc_id": c["doc_id"], "source": c["source"]} for c in contexts],
        "answer": answer, "prompt_chars": len(prompt), "answer_chars": len(answer), "latency_seconds": round(time.monotonic() - began, 3),
    }
