"""Contracts of routes, requests, data objects, pages and forms."""

import pytest

from lintlake.operators import contracts, php

C = "app/Http/Controllers/UserController.php"
FILES = {
    "routes/web.php": """<?php
Route::post('/users', [UserController::class, 'store'])->name('users.store');
Route::get('/users', [UserController::class, 'index']);
Route::get('/users/{user}/{post-id}/{more?}', [UserController::class, 'show']);
Route::put('/users/{user}', [UserController::class, 'update'])->name('users.update');
Route::get('/gone', [UserController::class, 'gone']);
Route::get('/nobody', [NobodyController::class, 'index']);
Route::get('/horizon/x', [NobodyController::class, 'index']);
Route::get('/lib', [\\Laravel\\Nova\\X::class, 'index']);
Route::get('/closure', fn () => 1);
Route::post('/one', OneController::class);
Route::get('/fine', [UserController::class, 'fine']);
Route::get('/page', [UserController::class, 'page']);
Route::get('/unknown', [UserController::class, 'unknown']);
""",
    C: """<?php
namespace App\\Http\\Controllers;
class UserController {
    public function store(StoreUserRequest $request) {
        $x = $request->input('name'); $request->only(['email', 'nick']); request('items.*.id');
        return UserData::fromRequest($request);
    }
    public function index(Request $request) {
        $request->query('page'); $request->input('sort');
        return Inertia::render('Users/Index', ['users' => [], 'meta' => ['a' => 1]]);
    }
    public function show($user, int $post_id) { return Inertia::render('Users/Gone'); }
    public function update(Request $request, User $user) {
        $request->validate(['name' => 'required|string', 'password' => ['required', 'confirmed'], 'nick' => 'nullable|required', 'tags.*.id' => 'required']);
        $request->input('password_confirmation'); $request->get('user'); $request->input('tags.0.id'); $request->input('role');
        return new UserData(name: $request->name, email: $request->email);
    }
    public function fine(Request $request) {
        $u = new AddressData('a', $b);
        return Inertia::render('Clinic/Show', [
            'thread' => $thread,
            'currentUser' => ['id' => (string) $user->id, 'name' => trans('a', ['b' => 1])],
        ]);
    }
    public function page() { $filters = 1; return Inertia::render('Users/Index', compact('users', 'filters')); }
    public function unknown() { return Inertia::render('Users/Index', $this->props()); }
}
""",
    "app/Http/Controllers/OneController.php": "<?php\nclass OneController {\n    public function __invoke(Request $request) { return $request->boolean('flag'); }\n}\n",
    "app/Http/Requests/StoreUserRequest.php": "<?php\nnamespace App\\Http\\Requests;\nclass StoreUserRequest extends FormRequest {\n    public function rules(): array {\n        return ['name' => 'required|string', 'email' => 'sometimes|required', 'items' => ['array']];\n    }\n}\n",
    "app/Data/UserData.php": "<?php\nnamespace App\\Data;\nclass UserData {\n    public function __construct(public string $name, public string $email, public ?string $nick, public array $a = [1, 2], private string $phone) {}\n}\n",
    "app/Data/AddressData.php": "<?php\nclass AddressData {\n    public function __construct(public string $street) {}\n}\n",
    "resources/js/Pages/Users/Index.tsx": "interface Props {\n  users: Array<object>;\n  filters: Record<string, string>;\n  optionalValue?: string;\n}\nexport default function Index({ users, filters }: Props) {\n  return null;\n}\n",
    "resources/js/pages/clinic/Show/Index.jsx": "export default function Show({ thread, currentUser, children }) {\n  return null;\n}\n",
    "resources/js/Components/New.tsx": "const form = useForm<X>({ name: '', email: '', items: [] });\nform.post(route('users.store'));\n",
    "resources/js/Components/Edit.tsx": "router.put(route('users.update', 1), { name, password: p, extra: 1 });\n",
    "resources/js/Components/Other.tsx": "submit(route('users.update'));\n",
    "null.php": None,
}


@pytest.fixture(scope="module")
def found(spark):
    sources = spark.createDataFrame(list(FILES.items()), "path string, content string")
    only_php = sources.filter("path like '%.php'")
    declared = php.declarations(only_php)
    got = contracts.contract_findings(php.routes(only_php), php.classes(declared, only_php), php.methods(declared), sources).collect()
    return {k: sorted((r.route, r.subject, r.severity, r.missing) for r in got if r.kind == k) for k in {r.kind for r in got}}


def test_targets(found):
    assert found["route_target"] == [("GET /gone", "UserController::gone", "high", []), ("GET /nobody", "NobodyController", "high", [])]


def test_requests(found):
    assert found["request_validation"] == [
        ("GET /users", "UserController::index", "medium", ["sort"]), ("POST /one", "OneController::__invoke", "high", ["flag"]), ("POST /users", "UserController::store", "high", ["nick"]),
        ("PUT /users/{user}", "UserController::update", "high", ["role"]),
    ]


def test_data_objects(found):
    assert found["dto_contract"] == [("GET /fine", "AddressData", "medium", ["street"]), ("POST /users", "App\\Data\\UserData", "high", ["phone"]), ("PUT /users/{user}", "App\\Data\\UserData", "high", ["phone"])]


def test_pages(found):
    assert found["inertia_page"] == [("GET /users/{user}/{post-id}/{more?}", "Users/Gone", "high", [])]
    assert found["inertia_props"] == [("GET /users", "Users/Index", "high", ["filters"])]


def test_forms(found):
    # New.tsx sends what is asked; Edit.tsx lacks the tags and sends more
    assert found["frontend_form_payload"] == [("PUT /users/{user}", "users.update", "high", ["+extra", "tags"])]


def test_bindings(found):
    assert found["route_model_binding"] == [("GET /users/{user}/{post-id}/{more?}", "UserController::show", "low", ["more"])]


def test_nothing(spark):
    none = spark.createDataFrame([], "path string, content string")
    declared = php.declarations(none)
    assert contracts.contract_findings(php.routes(none), php.classes(declared, none), php.methods(declared), none).count() == 0
