"""Documents: derived fields, null groups, schemas of both datasets."""

import json

import pytest

from planewatch import constants as K
from planewatch import schemas as S
from planewatch.operators import quality as Q
from planewatch.plans import derive
from planewatch.sources import archive as A
from tests.records import lines, observation, refusal, refused, spend, trace


def content(spark, base_url="", **fields):
    return derive.documents_from_lines(lines(spark, trace(**fields)), K.CONTENT, base_url).first()


def gateway(spark, record):
    return derive.documents_from_lines(lines(spark, record), K.GATEWAY).first()


def test_content_document(spark):
    d = content(spark, base_url="https://ui.example/")
    assert (d.dataset, d.event.dataset, d.event.kind, d.event.category, d.event.type, d.event.action) == (
        "content", "content", "event", ["api"], None, None)
    assert d.event.reference == "https://ui.example/project/p1/traces/t1"
    assert (d.llm.system_prompt, d.llm.user_prompt, d.llm.output, d.llm.message_count) == ("be kind", "hello", "hi there", 2)
    assert (d.gen_ai.system, d.gen_ai.operation.name, d.gen_ai.request.model, d.gen_ai.usage.output_tokens) == (
        "groq", "chat", "small", 20)
    assert (d.related.user, d.labels.scenario_outcome, d.error, d.document_id) == (["u1"], "benign", None, "t1")


def test_content_text_is_empty_not_absent(spark):
    d = content(spark, input=None, output=None)
    assert (d.llm.system_prompt, d.llm.user_prompt, d.llm.output, d.llm.messages) == ("", "", "", "")
    assert (d.llm.message_count, d.llm.output_length) == (0, 0)


def test_last_message_and_byte_length(spark):
    d = content(spark, input=[{"role": "user", "content": "a"}, {"role": "user", "content": "b"}], output={"content": "äß", "role": "x"})
    assert (d.llm.user_prompt, d.llm.system_prompt, d.llm.output_length) == ("b", "", 4)


def test_messages_are_encoded_with_escapes(spark):
    text = '<a href="x">&\u2028\n'
    encoded = content(spark, input=[{"role": "user", "content": text}]).llm.messages
    assert encoded.startswith('[{"role":"user","content":"\\u003ca href=\\"x\\"\\u003e\\u0026\\u2028\\n"}]')
    assert json.loads(encoded) == [{"role": "user", "content": text}]


@pytest.mark.parametrize("ref, base, expected", [
    ("https://x/y", "https://b", "https://x/y"), ("http://x", "https://b", "http://x"), ("/p", "", "/p"),
    ("//p", "https://b//", "https://b/p"), ("p", "https://b", "https://b/p"), (None, "https://b", None),
])
def test_reference(spark, ref, base, expected):
    assert content(spark, base_url=base, htmlPath=ref).event.reference == expected


@pytest.mark.parametrize("provider, model, expected", [
    ("groq", "groq/x", "groq"), (" Azure ", "x", "azure.ai.openai"), ("", "bedrock/x", "aws.bedrock"),
    ("newprov", "newprov/x", "unknown"), ("newprov", "openai/x", "openai"), ("", "plain", "unknown"), ("", "/x", "unknown"),
    (None, "OLLAMA_CHAT/x", "ollama"),
])
def test_provider_vocabulary(spark, provider, model, expected):
    assert gateway(spark, spend(custom_llm_provider=provider, model=model)).gen_ai.system == expected


@pytest.mark.parametrize("call_type, expected", [
    ("acompletion", "chat"), (" Embedding ", "embeddings"), ("atext_completion", "text_completion"), ("", "chat"), ("x", "chat"),
])
def test_operation_vocabulary(spark, call_type, expected):
    assert gateway(spark, spend(call_type=call_type)).gen_ai.operation.name == expected


@pytest.mark.parametrize("record, action, types, categories", [
    (spend(), "chat_completion", ["allowed"], ["api"]),
    (spend(status="odd"), "chat_completion", None, ["api"]),
    (refusal(), "budget_exceeded", ["denied"], ["api"]),
    (refusal("ProxyRateLimitError"), "rate_limited", ["denied"], ["api"]),
    (refusal("RateLimitError"), "rate_limited", ["denied"], ["api"]),
    (refusal("KeyNotFoundError", "401"), "auth_failure", ["denied", "start"], ["api", "authentication"]),
    (refusal("Odd", "403"), "auth_failure", ["denied", "start"], ["api", "authentication"]),
    (refusal("Odd", "500"), "request_failed", ["denied"], ["api"]),
    # The class decides before the status code does.
    (refusal("BudgetExceededError", "401"), "budget_exceeded", ["denied", "start"], ["api", "authentication"]),
])
def test_action_type_category(spark, record, action, types, categories):
    e = gateway(spark, record).event
    assert (e.action, e.type, e.category) == (action, types, categories)


def test_gateway_null_groups(spark):
    d = gateway(spark, refusal(meta={"spend_logs_metadata": None, "error_information": None, "user_api_key_alias": None,
                                     "user_api_key": None, "user_api_key_user_id": None}, api_key="", user=""))
    assert (d.trace, d.session, d.user, d.error, d.http, d.related, d.llm.key, d.gen_ai.response, d.gen_ai.usage) == (None,) * 9
    assert d.gen_ai.request.model == "small"
    d = gateway(spark, refusal())
    assert (d.error.type, d.error.code, d.error.message, d.http.response.status_code) == ("BudgetExceededError", "429", "no", 429)
    assert (d.llm.key.alias, d.llm.key.hash, d.related.user) == ("key-a", "hash-a", ["u1", "key-a"])


def test_related_users_are_distinct(spark):
    assert gateway(spark, spend({"user_api_key_alias": "u1"})).related.user == ["u1"]


def test_schemas(spark):
    docs = {
        K.CONTENT: derive.documents_from_lines(lines(spark, trace(observations=[observation(), refused()])), K.CONTENT),
        K.GATEWAY: derive.documents_from_lines(lines(spark, spend()), K.GATEWAY),
    }
    assert Q.declared_fields(docs[K.CONTENT].schema, S.CONTENT_DOCUMENT) == []
    assert Q.declared_fields(docs[K.GATEWAY].schema, S.GATEWAY_DOCUMENT) == []
    assert Q.schema_parity(docs[K.CONTENT].schema, docs[K.GATEWAY].schema) == []
    assert not {f for f in S.leaves(docs[K.GATEWAY].schema) if f.startswith("llm.") and f.split(".")[1] not in ("key", "total_cost_usd")}
    view = A.dataset_view(docs[K.CONTENT], docs[K.GATEWAY])
    row = view.filter("dataset = 'gateway'").first()
    assert (row.llm.output, row.llm.output_length, row.llm.messages) == (None, None, None)


def test_parity_finds_problems(spark):
    from pyspark.sql import types as T

    def broken(schema, name, dtype):
        return T.StructType([T.StructField(f.name, dtype if f.name == name else f.dataType) for f in schema.fields])

    assert Q.schema_parity(S.CONTENT_DOCUMENT, broken(S.GATEWAY_DOCUMENT, "tags", T.StringType())) == ["tags: array<string> and string"]
    only = T.StructType([f for f in S.GATEWAY_DOCUMENT.fields if f.name != "tags"])
    assert Q.schema_parity(S.CONTENT_DOCUMENT, only) == ["tags: in one dataset only"]


def test_a_misnamed_leaf_is_found():
    from pyspark.sql import types as T

    renamed = T.StructType([T.StructField("tagz" if f.name == "tags" else f.name, f.dataType) for f in S.CONTENT_DOCUMENT.fields])
    assert Q.declared_fields(renamed, S.CONTENT_DOCUMENT) == ["tags: never produced", "tagz: array<string>"]


def test_documents_survive_storing(spark, tmp_path):
    docs = A.dataset_view(
        derive.documents_from_lines(lines(spark, trace(), trace(id="t2")), K.CONTENT),
        derive.documents_from_lines(lines(spark, spend(), refusal()), K.GATEWAY),
    )
    path = str(tmp_path / "docs")
    A.write_documents(docs, path)
    stored = A.read_documents(spark, path)
    assert sorted(S.leaves(stored.schema)) == sorted(S.leaves(docs.schema))
    order = sorted(docs.columns)
    assert sorted(map(str, stored.select(order).collect())) == sorted(map(str, docs.select(order).collect()))
