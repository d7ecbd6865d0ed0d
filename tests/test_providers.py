"""Providers against canned replies."""

import json

import pytest

from quillspark.operators import providers as p
from quillspark.operators.classify import ProviderError
from quillspark.plans.agent import tool_specs

ITEMS = [{"id": "a", "title": "t", "source": None, "summary": None, "url": "u"}]
REPLY = '[{"id":"a","topic":"x","score":4}]'
TALK = [{"role": "user", "content": [{"type": "text", "text": "hi"}]}, {"role": "assistant", "content": [{"type": "tool_use", "id": "1", "name": "finish", "input": {"k": 1}}]},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "1", "name": "finish", "content": '{"ok": true}'}]}]


def canned(*replies):
    left, sent = list(replies), []

    def post(url, payload, headers):
        sent.append((url, payload, headers))
        return left.pop(0)

    post.sent = sent
    return post


def test_classifiers(spark):
    post = canned((200, {"message": {"content": REPLY}}))
    assert p.make_classifier(spark, "ollama", "m", post=post).classify("sys", ITEMS, 0.2)["a"]["topic"] == "x"
    assert json.loads(post.sent[0][1]["messages"][1]["content"])[0]["id"] == "a" and post.sent[0][1]["options"] == {"temperature": 0.2}
    slept = []
    post = canned((429, {}), (200, {"error": {"status": "RESOURCE_EXHAUSTED"}}), (200, {"candidates": [{"content": {"parts": [{"text": f"```json\n{REPLY}\n```"}]}}]}))
    gemini = p.make_classifier(spark, "gemini", "m", env={"GEMINI_API_KEY": "k"}, post=post, sleep=slept.append)
    assert gemini.classify("sys", ITEMS, 0.0)["a"]["score"] == 4 and slept == [2.0, 4.0]
    for bad in ((500, {}), (200, {"message": {}}), (200, {"message": {"content": "no list"}})):
        with pytest.raises(ProviderError):
            p.make_classifier(spark, "ollama", "m", post=canned(bad)).classify("s", ITEMS, 0)
    assert p.make_classifier(spark, "gemini", "m", env={}) is None
    with pytest.raises(ValueError):
        p.make_classifier(spark, "anthropic", "m")


def test_agents():
    assert p.make_agent({}) is None
    post = canned((200, {"content": [{"type": "text", "text": "a"}, {"type": "tool_use", "id": "9", "name": "finish", "input": {}}], "usage": {"input_tokens": 3, "output_tokens": 2}}))
    turn = p.make_agent({"ANTHROPIC_API_KEY": "k"}, post=post).complete("s", TALK, tool_specs())
    assert (turn.text, turn.calls, turn.tokens) == ("a", [("9", "finish", {})], (3, 2))
    assert post.sent[0][1]["messages"][2]["content"] == [{"type": "tool_result", "tool_use_id": "1", "content": '{"ok": true}'}]
    post = canned((200, {"candidates": [{"content": {"parts": [{"functionCall": {"name": "finish", "args": {"x": 1}}}]}}], "usageMetadata": {"promptTokenCount": 4}}))
    turn = p.make_agent({"GEMINI_API_KEY": "k"}, post=post).complete("s", TALK, tool_specs())
    assert turn.calls[0][1:] == ("finish", {"x": 1}) and turn.tokens == (4, 0)
    sent = post.sent[0][1]
    assert [c["role"] for c in sent["contents"]] == ["user", "model", "user"] and "additionalProperties" not in json.dumps(sent["tools"])
    with pytest.raises(ProviderError):
        p.make_agent({"GEMINI_API_KEY": "k"}, post=canned((200, {"candidates": []}))).complete("s", TALK, [])
