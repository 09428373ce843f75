"""Queries over route registration and contracts, with their SQL.

Sources are rendered from the suppliers: three route files that load each other, or a controller with its request, data
object, page and form, which agree or not as the supplier's balance and nation say.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.functions import dealt
from lintlake.operators import contracts, php, registration
from lintlake.plans.code import rendered


def _suppliers(s, d):
    kind = F.when(F.col("s_acctbal") < 0, "web").otherwise("api")
    return dealt(s.read.parquet(f"{d}/supplier.parquet")).withColumn("stack", kind)


def route_sources(s, d):
    t = _suppliers(s, d)
    files = {
        "app/Providers/P[[s_suppkey]].php": "<?php\nclass P[[s_suppkey]] { function boot() {\n    Route::middleware('[[stack]]')->prefix('n[[s_nationkey]]')->group(base_path('routes/[[s_suppkey]]/a.php'));\n} }\n",
        "routes/[[s_suppkey]]/a.php": "<?php\nRoute::middleware(['m[[s_nationkey]]'])->group(function () {\n    // require 'd.php';\n    require __DIR__.'/b.php';\n});\nRoute::get('/a', fn () => 1);\n",
        "routes/[[s_suppkey]]/b.php": "<?php\nRoute::prefix('deep')->group(function () {\n    require __DIR__ . '/c.php';\n});\nrequire __DIR__.'/a.php';\n",
        "routes/[[s_suppkey]]/c.php": "<?php\nRoute::post('/orders/{id}', [OrderController::class, 'store'])->middleware('auth');\n",
        "routes/[[s_suppkey]]/d.php": "<?php\nRoute::put('/d', [OrderController::class, 'd']);\n",
    }
    parts = [rendered(t, path, text) for path, text in files.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def route_registration(s, d):
    src = route_sources(s, d)
    r = registration.with_registration(php.routes(src), registration.registrations(src), registration.forgery_checks(src))
    return r.select("path", "verb", F.array_join("middleware", ",").alias("middleware"), F.array_join(F.array_sort("registered_uris"), ",").alias("uris"))


def contract_sources(s, d):
    t = _suppliers(s, d)
    t = t.withColumn("email", F.when(F.col("s_acctbal") > 2000, "'email' => 'required|email', ").otherwise(F.lit(""))).withColumn("phone", F.when(F.col("s_nationkey") < 12, "$request->input('phone.home'); ").otherwise(F.lit("")))
    t = t.withColumn("action", F.when(F.col("s_nationkey") == 3, "remove").otherwise("store")).withColumn("filters", F.when(F.col("s_nationkey") > 15, ", 'filters' => $f").otherwise(F.lit(""))).withColumn("slug", F.when(F.col("s_acctbal") < 0, ", $slug").otherwise(F.lit("")))
    k = "[[s_suppkey]]"
    files = {
        f"routes/{k}.php": f"<?php\nRoute::post('/s/{k}/{{slug}}', [S{k}Controller::class, '[[action]]'])->name('s{k}.store');\n",
        f"app/Http/Controllers/S{k}Controller.php": f"<?php\nnamespace App\\Http\\Controllers;\nclass S{k}Controller\n{{\n    public function store(Store{k}Request $request[[slug]])\n    {{\n        $request->input('name'); [[phone]]\n        $o = S{k}Data::fromRequest($request);\n"
        f"        return Inertia::render('S{k}/Index', ['users' => [1, [2]][[filters]]]);\n    }}\n}}\n",
        f"app/Http/Requests/Store{k}Request.php": f"<?php\nnamespace App\\Http\\Requests;\nclass Store{k}Request\n{{\n    public function rules()\n    {{\n        return [[[email]]'name' => ['required', 'string']];\n    }}\n}}\n",
        f"app/Data/S{k}Data.php": f"<?php\nnamespace App\\Data;\nclass S{k}Data\n{{\n    public function __construct(public string $name, public string $email, public ?string $nick, public int $n = 1) {{}}\n}}\n",
        f"resources/js/Pages/S{k}/Index.tsx": "interface Props {\n  users: string[];\n  filters: Filters;\n  more?: string;\n}\nexport default function Index({ users, filters }: Props) {\n  return null;\n}\n",
        f"resources/js/Forms/S{k}.tsx": f"form.post(route('s{k}.store', 1), {{ name: a, nation: [[s_nationkey]] }});\n",
    }
    parts = [rendered(t, path, text) for path, text in files.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contract_findings(s, d):
    src = contract_sources(s, d)
    code = src.filter(F.col("path").endswith(".php"))
    declared = php.declarations(code)
    found = contracts.contract_findings(php.routes(code), php.classes(declared, code), php.methods(declared), src)
    return found.select("kind", "file", F.col("line").cast("long").alias("line"), "severity", "route", F.array_join("missing", ",").alias("missing"))


SQL = {
    "route_registration": """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, CASE WHEN s_acctbal < 0 THEN 'web' ELSE 'api' END AS st FROM supplier),
m AS (SELECT *, CASE st WHEN 'web' THEN 'm' || n || ',web,verifycsrftoken' ELSE 'api,m' || n END AS held FROM s)
SELECT 'routes/' || k || '/a.php' AS path, 'get' AS verb, held AS middleware, '/n' || n || '/a' AS uris FROM m
UNION ALL SELECT 'routes/' || k || '/c.php', 'post', 'auth,' || held, '/n' || n || '/deep/orders/{id}' FROM m
UNION ALL SELECT 'routes/' || k || '/d.php', 'put', '', '/d' FROM m""",
    "contract_findings": """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_acctbal AS b, 'POST /s/' || s_suppkey || '/{slug}' AS route, 'app/Http/Controllers/S' || s_suppkey || 'Controller.php' AS c FROM supplier),
t AS (SELECT * FROM s WHERE n <> 3)
SELECT 'route_target' AS kind, c AS file, 2::BIGINT AS line, 'high' AS severity, route, '' AS missing FROM s WHERE n = 3
UNION ALL SELECT 'request_validation', c, 5, 'high', route, 'phone' FROM t WHERE n < 12
UNION ALL SELECT 'dto_contract', c, 5, 'high', route, 'email' FROM t WHERE b <= 2000
UNION ALL SELECT 'inertia_props', c, 5, 'high', route, 'filters' FROM t WHERE n <= 15
UNION ALL SELECT 'frontend_form_payload', 'resources/js/Forms/S' || k || '.tsx', 1, CASE WHEN b > 2000 THEN 'high' ELSE 'medium' END, route, CASE WHEN b > 2000 THEN '+nation,email' ELSE '+nation' END FROM t
UNION ALL SELECT 'route_model_binding', c, 5, 'low', route, 'slug' FROM t WHERE b >= 0""",
}
QUERIES = {n: globals()[n] for n in SQL}
