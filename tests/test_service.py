"""The JSON service and the command line."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

from loomstone.__main__ import main
from loomstone.http import MOST_BYTES, Service, server


def test_service(spark, tmp_path):
    service = Service(spark, f"file://{tmp_path}/c", token="t0ken", secret=b"s")
    web = server(service)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{web.server_port}/v1/"

    def ask(route, body=None, status=200, method=None, **headers):
        headers = {"Authorization": "Bearer t0ken", "X-Tenant": "t", "X-Branch": "db_beds:main"} | {k.replace("_", "-"): v for k, v in headers.items()}
        request = urllib.request.Request(base + route, None if body is None else json.dumps(body).encode(), headers, method=method)
        try:
            with urllib.request.urlopen(request) as answer:
                got, code = json.load(answer), answer.status
        except urllib.error.HTTPError as error:
            got, code = json.load(error), error.code
        assert code == status, got
        return got

    assert ask("health") == {"ok": True} and "error" in ask("databases", status=401, Authorization="x")
    ask("databases", {"org_id": "o", "project_id": "p", "name": "beds", "region": "north"})
    assert ask("branches", {"database_id": "db_beds", "name": "main"})["branch_id"] == "db_beds:main"
    ask("schema/apply", {"name": "plants", "texts": ["notes"]})
    put = {"table": "plants", "tenant_id": "t", "id": "fern", "fields": {"notes": "wet moss"}}
    assert ask("records/put", put, Idempotency_Key="k") == ask("records/put", put, Idempotency_Key="k") == {"epoch": 1}
    ask("records/put", put | {"fields": {}}, 409, Idempotency_Key="k")
    assert ask("records/get", {"table": "plants", "tenant_id": "t", "id": "fern"})["fields"]["notes"] == "wet moss"
    assert ask("records/get", {"table": "plants", "tenant_id": "t", "id": "none"}, 404)["code"] == "NotFound"
    ask("records/get", {"table": "plants", "tenant_id": "u", "id": "fern"}, 403)
    assert ask("query", {"table": "plants", "tenant_id": "t", "text": "moss"})["results"][0]["record_id"] == "fern"
    assert ask("statement", {"text": "FROM plants\nTENANT t\nMATCH notes moss"})["results"][0]["record_id"] == "fern"
    assert ask("graphql/bounded", {"query": '{ plants(tenant_id: "t", match: "moss") { record_id } }'})["results"][0]["record_id"] == "fern"
    assert "type Query" in ask("graphql/schema")["schema"] and ask("graphql", {"query": "{ jobs }"})["data"]["jobs"] == {"jobs": []}
    ask("jobs/run", {"kind": "verify_database", "target": "x"})
    job = ask("internal/jobs/lease", {"kind": "verify_database", "worker_id": "w"})["job"]
    assert ask("internal/jobs/complete", {"job_id": job["job_id"], "token": job["lease_token"]})["job"]["status"] == "Succeeded"
    ask("nope", {}, 400)
    ask("query", [1], 400)
    assert ask("metrics")["requests"]["health"] == 1 and len(ask("databases")["databases"]) == len(ask("branches")["branches"]) == 1
    big = urllib.request.Request(base + "query", b"{}", {"Content-Length": str(MOST_BYTES + 1)})
    assert service.handle("GET", "/v1/ready", {}, b"")[0] == 200 and big.get_header("Content-length") == str(MOST_BYTES + 1)
    web.shutdown()


def test_command_line(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/db"
    run = lambda *a: main([*a, "--root", root], spark)
    assert run("run", 'SCHEMA APPLY {"name": "plants", "texts": ["notes"]}', "--tenant", "t") == 0
    assert run("run", 'PUT {"table": "plants", "tenant_id": "t", "id": "fern", "fields": {"notes": "moss"}}', "--tenant", "t") == 0
    assert run("run", 'GET {"table": "plants", "tenant_id": "t", "id": "none"}', "--tenant", "t") == 1
    assert run("task", "compact") == 0 and run("inspect") == 0 and run("verify") == 0
    out, err = capsys.readouterr()
    lines = [json.loads(x) for x in out.splitlines()]
    assert lines[0] == {"table": "plants"} and lines[1] == {"epoch": 1} and lines[2]["status"] == "Succeeded" and lines[3]["epoch"] == 1 and lines[4] == {"damaged": []}
    assert "NotFound" in err
