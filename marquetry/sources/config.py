"""Configuration, changed files, benchmarks, rankings and entry points from project files.

These are small files read on the driver; what they say becomes parameters or narrow tables.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = {"M": "modified", "A": "added", "D": "deleted", "R": "renamed", "C": "copied"}


@dataclass
class Config:
    """Thresholds and entry-point rules; unknown keys are an error."""

    min_confidence: str = "low"
    min_lines: int = 6
    similarity: float = 0.8
    max_dead_code: int | None = None
    max_clones: int | None = None
    max_scaffolding: int | None = None
    entry_functions: list[str] = field(default_factory=list)
    entry_attributes: list[str] = field(default_factory=list)
    entry_prefixes: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None, prefix: str = "MARQUETRY_") -> Config:
        """Values of a TOML or JSON file, then of ``PREFIX_NAME`` variables."""
        import tomllib

        values: dict = {}
        if path is not None:
            with open(path, "rb") as f:
                values = json.load(f) if path.endswith(".json") else tomllib.load(f)
        out = cls(**values)
        for name, kind in cls.__annotations__.items():
            text = (os.environ if env is None else env).get(prefix + name.upper())
            if text is not None:
                setattr(out, name, text.split(",") if "list" in kind else float(text) if "float" in kind else int(text) if "int" in kind else text)
        return out

    def limits(self) -> dict[str, int]:
        named = {"dead_code": self.max_dead_code, "clones": self.max_clones, "scaffolding": self.max_scaffolding}
        return {k: v for k, v in named.items() if v is not None}


#: Names under which a configuration is looked for, in order.
CANDIDATES = ("marquetry.toml", ".marquetry.toml", "marquetry.json", ".marquetry.json", ".config/marquetry.toml")


def discover(root: str, env: dict[str, str] | None = None) -> Config:
    """The first configuration under ``root``, else the defaults; variables come on top."""
    paths = (os.path.join(root, name) for name in CANDIDATES)
    return Config.load(next((p for p in paths if os.path.exists(p)), None), env=env)


#: What tells a framework, and the names and attributes that it calls by itself.
#: A short table; ``load_presets`` adds others from a file.
PRESETS: dict[str, dict] = {
    "actix": {"deps": ["actix-web"], "prefixes": ["#[get(", "#[post(", "#[put(", "#[delete(", "#[actix_web::"]},
    "angular": {"files": ["angular.json"], "deps": ["@angular/core"], "prefixes": ["@Component", "@Directive", "@Injectable", "@NgModule", "@Pipe"], "functions": ["ngOnInit", "ngOnDestroy", "ngOnChanges"]},
    "aspnet": {"deps": ["microsoft.aspnetcore"], "prefixes": ["[ApiController", "[Authorize", "[Http", "[Route"]},
    "aws_cdk": {"files": ["cdk.json"], "deps": ["aws-cdk-lib", "@aws-cdk/core"], "functions": ["handler", "lambda_handler"]},
    "axum": {"deps": ["axum"], "prefixes": ["#[debug_handler", "#[tokio::main"], "functions": ["app", "router"]},
    "celery": {"deps": ["celery"], "prefixes": ["app.task", "shared_task"]},
    "criterion": {"deps": ["criterion"], "prefixes": ["#[bench"]},
    "django": {"files": ["manage.py"], "deps": ["django"], "attributes": ["receiver", "admin.register", "login_required", "csrf_exempt"], "functions": ["ready", "handle"]},
    "express": {"deps": ["express"], "attributes": ["route", "handler", "endpoint"]},
    "fastapi": {"deps": ["fastapi"], "prefixes": ["app.delete", "app.get", "app.post", "app.put", "router."]},
    "flask": {"deps": ["flask"], "prefixes": ["app.route", "app.before_request", "app.errorhandler", "bp.route", "blueprint."]},
    "jpa": {"deps": ["javax.persistence", "jakarta.persistence", "hibernate"], "prefixes": ["@Embeddable", "@Entity", "@MappedSuperclass", "@PrePersist"]},
    "lombok": {"deps": ["lombok", "org.projectlombok"], "prefixes": ["@Builder", "@Data", "@Getter", "@Setter", "@Value"]},
    "nestjs": {"deps": ["@nestjs/core", "@nestjs/common"], "prefixes": ["@Controller", "@Delete", "@Get", "@Injectable", "@Module", "@Post", "@Put"], "functions": ["onModuleInit", "onModuleDestroy"]},
    "next": {"files": ["next.config.js", "next.config.mjs", "next.config.ts"], "deps": ["next"], "functions": ["GET", "POST", "PUT", "DELETE", "generateMetadata", "generateStaticParams", "getServerSideProps", "getStaticPaths", "getStaticProps", "middleware"]},
    "pytest": {"files": ["conftest.py", "pytest.ini"], "deps": ["pytest"], "prefixes": ["pytest."]},
    "r6": {"deps": ["r6"], "functions": ["initialize", "finalize", "print", "clone"]},
    "rails": {"files": ["config/application.rb"], "deps": ["rails"], "functions": ["index", "show", "create", "update", "destroy"]},
    "react": {"deps": ["react", "react-dom"], "functions": ["App", "render", "componentDidMount", "componentDidUpdate", "componentWillUnmount"]},
    "rust": {"files": ["Cargo.toml"], "prefixes": ["#[derive(", "#[no_mangle", "#[serde"]},
    "serde": {"deps": ["serde"], "functions": ["default", "deserialize", "fmt", "from", "serialize"]},
    "shiny": {"deps": ["shiny"], "functions": ["moduleServer", "observe", "reactive", "runApp", "server", "shinyApp", "ui"]},
    "spring": {"files": ["pom.xml", "build.gradle", "build.gradle.kts"], "deps": ["spring-boot", "org.springframework"], "prefixes": ["@Bean", "@Component", "@Configuration", "@Controller", "@DeleteMapping", "@EventListener", "@GetMapping", "@PatchMapping", "@PostConstruct", "@PostMapping", "@PreDestroy", "@PutMapping", "@Repository", "@RequestMapping", "@RestController", "@Scheduled", "@Service"]},
    "swiftui": {"deps": ["swiftui"], "prefixes": ["@main"], "functions": ["body", "makeBody"]},
    "tidyverse": {"deps": ["tidyverse", "dplyr", "ggplot2", "tidyr", "readr", "purrr"], "functions": ["arrange", "filter", "mutate", "select", "summarise"]},
    "uikit": {"deps": ["uikit"], "prefixes": ["@IBAction", "@objc"], "functions": ["viewDidLoad", "viewWillAppear"]},
    "vapor": {"deps": ["vapor"], "functions": ["boot", "configure", "routes"]},
    "vue": {"deps": ["vue", "nuxt"], "functions": ["beforeMount", "created", "mounted", "setup", "updated"]},
    "xctest": {"deps": ["xctest"], "functions": ["setUp", "setUpWithError", "tearDown"]},
}


def load_presets(path: str) -> dict[str, dict]:
    """The built-in presets with those of a JSON file, which replace equal names."""
    with open(path, encoding="utf-8") as f:
        return {**PRESETS, **json.load(f)}


def dependencies(root: str) -> set[str]:
    """Names that manifests of a project declare."""
    found: set[str] = set()
    path = os.path.join(root, "package.json")
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        found |= {*data.get("dependencies", {}), *data.get("devDependencies", {})}
    for name, pattern in (
        ("requirements.txt", r"(?m)^\s*([A-Za-z0-9_.-]+)"), ("pyproject.toml", r"[\"']([A-Za-z0-9_.-]+)\s*(?:[<>=~!\[][^\"']*)?[\"']"), ("Cargo.toml", r"(?m)^\s*([A-Za-z0-9_-]+)\s*="),
        ("DESCRIPTION", r"(?:Imports|Depends|Suggests):|(?<=[\s,:])([A-Za-z][A-Za-z0-9.]+)(?=\s*(?:,|\(|\n|$))"), ("Gemfile", r"(?m)^\s*gem\s+['\"]([\w-]+)"), ("pom.xml", r"<(?:groupId|artifactId)>([\w.-]+)<"), ("build.gradle", r"['\"]([\w.-]+):[\w.-]+"), ("Package.swift", r"/([A-Za-z0-9_-]+?)(?:\.git)?\""),
    ):
        path = os.path.join(root, name)
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                found |= {x.lower() for x in re.findall(pattern, f.read())}
    return found


def swift_imports(root: str, most_depth: int = 10) -> set[str]:
    """Modules that Swift files import, in lower case."""
    found: set[str] = set()
    for folder, names, files in os.walk(root):
        names[:] = [] if os.path.relpath(folder, root).count(os.sep) >= most_depth else [n for n in names if not n.startswith(".")]
        for name in files:
            if name.endswith(".swift"):
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    found |= {x.lower() for x in re.findall(r"(?m)^\s*import\s+(\w+)", f.read())}
    return found


def detect_presets(root: str, presets: dict[str, dict] | None = None) -> list[str]:
    deps = {x.lower() for x in dependencies(root)} | swift_imports(root)
    has = lambda p: any(os.path.exists(os.path.join(root, f)) for f in p.get("files", [])) or deps & set(p.get("deps", []))
    return sorted(k for k, p in (presets or PRESETS).items() if has(p))


def entry_rules(presets: list[str], config: Config | None = None, table: dict[str, dict] | None = None) -> dict[str, list[str]]:
    """Options of ``textrules.entry_points`` from presets and configuration."""
    config = config or Config()
    get = lambda k: sorted({x for p in presets for x in (table or PRESETS)[p].get(k, [])})
    return {
        "exact": get("attributes") + config.entry_attributes, "prefixes": get("prefixes") + config.entry_prefixes,
        "functions": get("functions") + config.entry_functions,
    }


def entry_files(root: str, most_depth: int = 10) -> set[str]:
    """Files that container, package and deployment files name as programs to start."""
    found: set[str] = set()
    for folder, names, files in os.walk(root):
        depth = os.path.relpath(folder, root).count(os.sep)
        names[:] = [] if depth >= most_depth else [n for n in names if not n.startswith(".") and n != "node_modules"]
        rel = os.path.relpath(folder, root)
        place = lambda x, rel=rel: os.path.normpath(os.path.join(rel, x))
        for name in files:
            path = os.path.join(folder, name)
            if name == "Dockerfile" or name.startswith("Dockerfile."):
                with open(path, encoding="utf-8") as f:
                    for line in re.findall(r"(?m)^(?:ENTRYPOINT|CMD)\s+(.*)$", f.read()):
                        found |= {place(x) for x in re.findall(r"[\w./-]+\.\w{1,4}\b", line)}
            elif name == "package.json":
                with open(path, encoding="utf-8") as f:
                    data = json.load(f)
                text = json.dumps([data.get(k) for k in ("main", "module", "bin", "exports", "scripts")])
                found |= {place(x) for x in re.findall(r"[\w./-]+\.(?:[cm]?[jt]sx?)\b", text)}
            elif name == "cdk.json":
                with open(path, encoding="utf-8") as f:
                    found |= {place(x) for x in re.findall(r"[\w./-]+\.(?:py|ts|js)\b", json.load(f).get("app", ""))}
            elif re.fullmatch(r"(?:docker-)?compose(?:\.[\w-]+)?\.ya?ml", name):
                with open(path, encoding="utf-8") as f:
                    text = f.read()
                homes = re.findall(r"(?m)^\s*(?:build|context):\s*['\"]?([\w./-]+)['\"]?\s*$", text) or ["."]
                for line in re.findall(r"(?m)^\s*(?:command|entrypoint):\s*(.+)$", text):
                    found |= {place(os.path.join(h, x)) for h in homes for x in re.findall(r"[\w./-]+\.\w{1,4}\b", line)}
            elif name in ("setup.py", "setup.cfg"):
                with open(path, encoding="utf-8") as f:
                    for module in re.findall(r"=\s*([\w.]+):\w+", f.read()):
                        found.add(place(module.replace(".", "/") + ".py"))
            elif name == "pyproject.toml":
                with open(path, encoding="utf-8") as f:
                    for module in re.findall(r"=\s*[\"']([\w.]+):\w+[\"']", f.read()):
                        found.add(place(module.replace(".", "/") + ".py"))
    return found


def parse_changes(text: str) -> list[tuple[str, str]]:
    """``(path, change)`` of a name-status listing; renames and copies give their new path."""
    rows = []
    for line in text.splitlines():
        parts = line.split("\t")
        if len(parts) >= 2 and parts[0][:1] in CHANGES:
            rows.append((parts[2] if parts[0][0] in "RC" and len(parts) > 2 else parts[1], CHANGES[parts[0][0]]))
    return rows


def changed_files(spark: SparkSession, root: str, base: str) -> DataFrame:
    """``(path, change)`` between ``base`` and the work tree."""
    if base.startswith("-"):
        raise ValueError("a revision must not begin with a dash")
    out = subprocess.run(["git", "-C", root, "diff", "--name-status", base], capture_output=True, text=True, check=True)
    return spark.createDataFrame(parse_changes(out.stdout), "path string, change string")


def clone_benchmark(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Fragments and pairs of a clone benchmark; unknown types count as type 3."""
    fragments = spark.read.csv(f"{folder}/functions.csv", header=True, schema="id string, file string, start_line int, end_line int, functionality_id string", enforceSchema=True)
    pairs = spark.read.csv(f"{folder}/clones.csv", header=True, schema="a string, b string, type string, is_clone string", enforceSchema=True)
    kind = F.regexp_extract(F.lower("type"), r"([124])", 1)
    return fragments, pairs.select(
        "a", "b", F.concat(F.lit("type"), F.when(kind != "", kind).otherwise("3")).alias("type"), F.lower("is_clone").isin("true", "1", "yes").alias("is_clone")
    )


def weekly_ranking(spark: SparkSession, path: str) -> DataFrame:
    """``(week, project, metrics...)`` of a local ranking file."""
    schema = "week string, projects array<struct<name:string,dead_code:long,clones:long,scaffolding:long,lines:long>>"
    rows = spark.read.schema(f"weeks array<struct<{schema.replace('week string, projects ', 'week:string,projects:')}>>").json(path, multiLine=True)
    weeks = rows.select(F.explode("weeks").alias("w")).select("w.week", F.explode("w.projects").alias("p"))
    return weeks.select("week", F.col("p.name").alias("project"), "p.dead_code", "p.clones", "p.scaffolding", "p.lines")
