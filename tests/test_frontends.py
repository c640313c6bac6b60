"""Front ends on small sources whose facts are known, and on noise."""

from __future__ import annotations

import random

import pytest

from graphloom.operators import resolution
from graphloom.operators.similarity import similar_pairs
from graphloom.sources import repository
from graphloom.sources.frontends import parse_braced
from graphloom.sources.lexing import TYPE_WORDS, Source

JAVA = '''package com.acme;
import org.springframework.web.client.RestTemplate;
@RestController
@RequestMapping("/api")
public class Orders extends Base implements Audited, Closeable {
  private static final String PAY = "/payments";
  private final RestTemplate rest; KafkaTemplate<String, Order> kafka; WebClient web; JdbcTemplate jdbc; ApplicationEventPublisher events;
  @GetMapping("/{id}")
  public Order one(@PathVariable Map<String, Long> id, int n) {
    // rest.getForObject("/never", X.class);
    rest.getForObject(PAY + "/" + id, Order.class);
    web.post().uri("/ship").retrieve();
    kafka.send("orders", "payload");
    events.publishEvent(new Shipped(id));
    jdbc.query("SELECT a FROM t_order", mapper);
    for (int i = 0; i < n; i++) { while (id != null) { if (n > 1 && i > 2) { return null; } else if (n < 0) { throw x(); } } }
    return n > 0 ? a : b;
  }
  @KafkaListener(topics = {"shipped", "lost"})
  void on(String s) { }
  @EventListener
  void at(Shipped e) { try { f(); } catch (E x) { g(); } finally { h(); } }
}
@FeignClient(name = "stock", path = "/stock")
interface Stock { @GetMapping("/{sku}") Item item(String sku); }
@Path("/old") class Old { @GET @Path("/all") public String all() { return ""; } }
'''
TYPESCRIPT = '''import axios from "axios";
import express from 'express';
import { Kafka } from "kafkajs";
const Queue = require("bull");
const api = axios.create({ baseURL: "/v1" });
const mail = new Queue("emails");
const User = mongoose.model("User", schema);
const BASE = "/base";
const app = express();
app.get("/users", list);
async function list(req, res) { const a = await fetch(`${BASE}/items/${req.id}`, { method: "PUT" }); api.post("/login", {}); }
@Controller("cats")
export class Cats extends Pets {
  @Get(":id") one(id: string): Promise<Cat> { return prisma.cat.findUnique({ id }); }
  save = async (x) => { await User.create(x); mail.add({}); producer.send({ topic: "saved", messages: [] }); knex("logs").where(x).del(); };
}
// fetch("/never")
const pattern = /fetch("\\/no")/;
'''
GO = '''package main
import (
	"fmt"
	"net/http"
	"github.com/gin-gonic/gin"
)
type Server struct { db int }
func (s *Server) Load(id int) error {
	http.Get("http://h/x")
	http.NewRequest("PATCH", fmt.Sprintf("/u/%d/z", id), nil)
	return nil
}
func main() {
	r := gin.Default()
	r.GET("/ping", ping)
	http.HandleFunc("POST /in/{id}", ping)
}
func ping(c *gin.Context) { if x := f(); x > 0 { g() } }
'''
KOTLIN = '''package com.k
class Calls(private val rest: RestTemplate) : Base(), Marked {
  @PostMapping("/k")
  fun send(a: Map<String, Int>, b: Int): String = rest.postForObject("/there", a, String::class.java)
  fun named(id: Int) { rest.delete("/things/$id") }
}
'''
PYTHON = '''import requests
ROOT = "/root"
class Client(Base):
    def load(self, x):
        if x:
            for y in x:
                requests.get(f"{ROOT}/a/{y}")
        return requests.request("post", "/b")
def store(cur):
    cur.execute("INSERT INTO log VALUES (1)")
requests.put("/top")
'''


def sites(facts):
    return {(s["kind"], s["framework"], s["method"], s["literal"] or s["folded"], s["src"].rsplit("#")[-1]) for s in facts["sites"]}


def test_java():
    facts = parse_braced("a/Orders.java", JAVA, "java")
    assert sites(facts) == {
        ("http", "resttemplate", "GET", "/payments/${}", "one/2"), ("http", "webclient", "POST", "/ship", "one/2"), ("publish", "kafka", None, "orders", "one/2"),
        ("publish", "spring", None, "Shipped", "one/2"), ("query", "jdbc", "query", "SELECT a FROM t_order", "one/2"), ("listen", "kafka", None, "shipped", "on/1"),
        ("listen", "kafka", None, "lost", "on/1"), ("listen", "spring", None, "Shipped", "at/1"), ("http", "feign", "GET", "/stock/{sku}", "item/1"),
    }
    assert {(r["method"], r["path"], r["framework"]) for r in facts["routes"]} == {("GET", "/api/{id}", "spring"), ("GET", "/old/all", "jaxrs")}
    assert {(h["child"], h["parent"], h["kind"]) for h in facts["heritage"]} == {("Class:com.acme.Orders", "Base", "extends"), ("Class:com.acme.Orders", "Audited", "implements"), ("Class:com.acme.Orders", "Closeable", "implements")}
    one = next(d for d in facts["defs"] if d["name"] == "one")
    # 1 + for, while, if, else if, &&, ?: and 1 + 2 + 3 + 4 + 1 + 1 for the same.
    assert (one["id"], one["cyclomatic"], one["cognitive"], one["loop_depth"], one["first"], one["last"]) == ("Method:com.acme.Orders#one/2", 7, 12, 2, 9, 18)
    at = next(d for d in facts["defs"] if d["name"] == "at")
    assert (at["cyclomatic"], at["cognitive"]) == (2, 3)


def test_typescript():
    facts = parse_braced("web/cats.ts", TYPESCRIPT, "typescript")
    assert sites(facts) == {
        ("http", "fetch", "PUT", "/base/items/${}", "list"), ("http", "axios", "POST", "/v1/login", "list"), ("query", "prisma", "findUnique", "cat", "one/1"),
        ("query", "orm", "create", "User", "save/1"), ("publish", "bull", None, "emails", "save/1"), ("publish", "kafka", None, "saved", "save/1"), ("query", "knex", "del", "logs", "save/1"),
    }
    assert {(r["method"], r["path"], r["handler"], r["framework"]) for r in facts["routes"]} == {("GET", "/users", "Function:web.cats#list", "express"), ("GET", "/cats/:id", "Method:web.cats.Cats#one/1", "nestjs")}
    assert facts["heritage"] == [{"child": "Class:web.cats.Cats", "parent": "Pets", "kind": "extends"}]


@pytest.mark.parametrize(
    "file,text,want",
    [
        ("pages/api/users/[id].ts", "export default function h() {}", {("ALL", "/api/users/:id")}),
        ("src/app/(shop)/cart/[...all]/route.ts", "export async function GET() {}\nexport const POST = 1;", {("GET", "/cart/:all"), ("POST", "/cart/:all")}),
        ("app/routes/blog.$slug.tsx", "export const loader = 1; export function action() {}", {("GET", "/blog/:slug"), ("POST", "/blog/:slug")}),
    ],
)
def test_routes_by_place(file, text, want):
    assert {(r["method"], r["path"]) for r in parse_braced(file, text, "typescript")["routes"]} == want


def test_go_and_kotlin():
    go = parse_braced("cmd/main.go", GO, "go")
    assert sites(go) == {("http", "nethttp", "GET", "http://h/x", "Load/1"), ("http", "nethttp", "PATCH", "/u/${}/z", "Load/1")}
    assert {(r["method"], r["path"], r["handler"]) for r in go["routes"]} == {("GET", "/ping", "Function:cmd.main#ping"), ("POST", "/in/{id}", "Function:cmd.main#ping")}
    kotlin = parse_braced("Calls.kt", KOTLIN, "kotlin")
    assert sites(kotlin) == {("http", "resttemplate", "POST", "/there", "send/2"), ("http", "resttemplate", "DELETE", "/things/${}", "named/1")}
    assert [(r["method"], r["path"], r["handler"]) for r in kotlin["routes"]] == [("POST", "/k", "Method:com.k.Calls#send/2")]
    assert [(h["parent"], h["kind"]) for h in kotlin["heritage"]] == [("Base", "extends"), ("Marked", "implements")]


def test_python():
    facts = repository.parse_python("lib/client.py", PYTHON)
    assert sites(facts) == {("http", "requests", "GET", "/root/a/${}", "load/1"), ("http", "requests", "POST", "/b", "load/1"), ("query", "dbapi", "execute", "INSERT INTO log VALUES (1)", "store/1"), ("http", "requests", "PUT", "/top", "File:lib/client.py")}
    assert facts["heritage"] == [{"child": "Class:lib.client.Client", "parent": "Base", "kind": "extends"}]
    assert next(d["cognitive"] for d in facts["defs"] if d["name"] == "load") == 3


@pytest.mark.parametrize("language", sorted(TYPE_WORDS))
def test_noise_ends(language):
    rng = random.Random(language)
    parts = ["class", "A", "b", "(", ")", "{", "}", "[", "]", "<", ">", "=>", "=", ":", ";", ",", ".", '"x"', "'", "`", "/", "if", "else", "for", "do", "while", "try", "catch", "case", "fun", "func", "fn", "function", "def", "impl", "for", "type", "struct", "@", "\n", "+", "1", "fetch", "get", "?", "&&", "//", "/*", "$", "é"]
    for _ in range(300):
        parse_braced("x/y.z", " ".join(rng.choices(parts, k=rng.randrange(60))), language)
    assert parse_braced("x.y", "", language)["defs"] == []


def test_long_chain_of_branches():
    source = Source("class A { void f() { " + "if (a) { b(); } else " * 20_000 + "{ c(); } } }", "java")
    body = source.callables[0].body
    assert source.complexity(*body)["cyclomatic"] == 20_001


def test_graphs(spark):
    sources = [("a/Orders.java", "java", JAVA), ("web/cats.ts", "typescript", TYPESCRIPT), ("main.go", "go", GO), ("c.py", "python", PYTHON)]
    body = "int f%d(int %s) { int s = 0; for (int i = 0; i < %s; i++) { s += g(i, %d); if (s > 9) { return s; } else if (s < 1) { s = s + i * 2; } } while (s > 0) { s = h(s - 1, i); } return s; }"
    twins = "class T { " + body % (1, "n", "n", 7) + body % (2, "count", "count", 8) + " int h() { return 1; } }"
    files = spark.createDataFrame([(f, x, t.encode()) for f, x, t in [*sources, ("T.java", "java", twins)]], "file string, language string, content binary")
    units = repository.parse(files).cache()
    nodes, edges = repository.route_graph(units)
    assert {"Route:GET /users", "Route:GET /api/{id}", "Route:POST /in/{id}"} <= {r.id for r in nodes.collect()}
    assert ("Function:web.cats#list", "Route:GET /users") in {(r.src, r.dst) for r in edges.collect()}
    nodes, edges = repository.query_graph(units)
    assert {r.id for r in nodes.where("kind = 'DbTable'").collect()} == {"DbTable:T_ORDER", "DbTable:CAT", "DbTable:USER", "DbTable:LOGS", "DbTable:LOG"}
    assert {(r.kind, r.dst) for r in edges.where("kind <> 'EXECUTES_QUERY'").collect()} == {("READS_TABLE", "DbTable:T_ORDER"), ("READS_TABLE", "DbTable:CAT"), ("WRITES_TABLE", "DbTable:USER"), ("WRITES_TABLE", "DbTable:LOGS"), ("WRITES_TABLE", "DbTable:LOG")}
    nodes, edges = resolution.contract_edges(repository.contract_sites(units))
    assert {"KafkaTopic:orders", "KafkaTopic:shipped", "ExternalEndpoint:PUT /top"} <= {r.id for r in nodes.collect()}
    pairs, members = similar_pairs(repository.body_signatures(units))
    same = {r.id: r["class"] for r in members.collect()}
    assert same["Method:T#f1/1"] == same["Method:T#f2/1"] and "Method:T#h/0" not in same
