"""Rule tables as data. Users extend behaviour by passing tables of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Needles, capability, domain, implementation, base strength. A needle with *
# in front also matches longer words.
CAPABILITIES: list[tuple[str, str, str, str | None, float]] = [
    ("diffusers stable-diffusion comfyui sdxl text2image txt2img", "Image Generation", "ai", "Diffusion", 0.9),
    ("openai gpt dall-e dalle", "Image Generation", "ai", "OpenAI", 0.8),
    ("qwen-image wanx tongyi-wanxiang", "Image Generation", "ai", "Qwen", 0.85),
    ("torchvision.models.detection yolo ultralytics detectron mmdetection", "Object Detection", "ai", "YOLO", 0.85),
    ("segment-anything sam2 mask2former *segmentation", "Image Segmentation", "ai", None, 0.8),
    ("video-generation text2video img2video animatediff wan2 cogvideo mochi", "Video Generation", "ai", None, 0.85),
    ("moviepy ffmpeg opencv imageio", "Video Processing", "media", None, 0.7),
    ("whisper faster-whisper funasr speech-recognition", "Speech Recognition", "ai", "Whisper", 0.85),
    ("tts edge-tts cosyvoice vits bark coqui", "Text To Speech", "ai", None, 0.85),
    ("text-generation llama chatglm baichuan qwen mistral gemma", "Text Generation", "ai", None, 0.8),
    ("langchain llamaindex llama-index haystack", "RAG", "ai", "LangChain", 0.85),
    ("embedding bge sentence-transformers fastembed text-embedding", "Embedding", "ai", None, 0.8),
    ("chromadb chroma qdrant milvus pinecone weaviate faiss lancedb", "Vector Search", "ai", None, 0.8),
    ("*rerank bge-reranker cohere-rerank cross-encoder", "Reranking", "ai", None, 0.75),
    ("vision-language vlm qwen-vl llava clip gpt-4-vision minicpm", "Vision Language Model", "ai", None, 0.8),
    ("ocr tesseract paddleocr easyocr rapidocr", "OCR", "ai", None, 0.8),
    ("lora controlnet ip-adapter peft *finetune *fine-tune sft", "Model Fine-tuning", "ai", None, 0.8),
    ("onnx onnxruntime tensorrt openvino *quantiz int8 4bit gguf", "Model Optimization", "ai", None, 0.75),
    ("langgraph autogen crewai metagpt swarm", "Agent Orchestration", "ai", None, 0.85),
    ("mcp model-context-protocol", "MCP Integration", "ai", "MCP", 0.9),
    ("tool-call tool_call function-call function_call toolcall", "Tool Calling", "ai", None, 0.8),
    ("prompt-template prompt_template jinja *prompt-engineer prompthub", "Prompt Engineering", "ai", None, 0.75),
    ("react react-dom next remix", "Web Frontend", "web", "React", 0.8),
    ("vue nuxt vite element-plus", "Web Frontend", "web", "Vue", 0.8),
    ("svelte sveltekit", "Web Frontend", "web", "Svelte", 0.8),
    ("angular", "Web Frontend", "web", "Angular", 0.8),
    ("tailwind tailwindcss antd ant-design mui chakra shadcn", "UI Component Library", "web", None, 0.7),
    ("three threejs babylonjs webgl cesium", "3D Rendering", "web", "Three.js", 0.8),
    ("echarts chart.js d3 highcharts plotly", "Data Visualization", "web", None, 0.75),
    ("tauri electron wails", "Desktop App", "web", None, 0.85),
    ("fastapi flask django starlette", "Web API", "web", None, 0.8),
    ("express koa nestjs fastify axum actix gin spring-boot spring-web", "Web API", "web", None, 0.8),
    ("websocket socket.io ws sse server-sent", "Realtime Communication", "web", None, 0.75),
    ("graphql apollo relay", "GraphQL", "web", None, 0.8),
    ("grpc protobuf tonic thrift", "RPC", "web", None, 0.75),
    ("oauth jwt jsonwebtoken passlib bcrypt authlib casbin", "Authentication", "web", None, 0.8),
    ("pandas polars numpy dataframe", "Data Processing", "data", None, 0.75),
    ("sqlalchemy prisma typeorm sequelize diesel mybatis hibernate", "ORM", "data", None, 0.75),
    ("postgres postgresql mysql mariadb sqlite rusqlite clickhouse duckdb", "Relational Database", "data", None, 0.7),
    ("redis memcached keydb", "Caching", "data", None, 0.75),
    ("mongodb pymongo mongoose", "Document Database", "data", None, 0.75),
    ("elasticsearch opensearch solr", "Full-text Search", "data", None, 0.75),
    ("alembic flyway liquibase *migration", "Schema Migration", "data", None, 0.65),
    ("scrapy beautifulsoup playwright puppeteer selenium *crawl *spider", "Web Scraping", "data", None, 0.75),
    ("airflow dagster prefect luigi", "Workflow Orchestration", "data", None, 0.75),
    ("celery rq dramatiq huey task-queue taskqueue bullmq arq", "Task Queue", "infrastructure", None, 0.85),
    ("rabbitmq kafka pulsar nats amqp mqtt", "Message Queue", "infrastructure", None, 0.8),
    ("docker dockerfile docker-compose podman containerd", "Containerization", "infrastructure", None, 0.75),
    ("kubernetes k8s helm kubectl", "Container Orchestration", "infrastructure", None, 0.75),
    ("terraform pulumi ansible cloudformation", "Infrastructure As Code", "infrastructure", None, 0.7),
    ("prometheus grafana opentelemetry otel sentry datadog", "Observability", "infrastructure", None, 0.7),
    ("pytest jest vitest junit mocha cypress playwright-test tests test __tests__ spec", "Testing", "infrastructure", None, 0.6),
    ("github-actions gitlab-ci jenkins circleci ci-cd cicd", "CI/CD", "infrastructure", None, 0.65),
    ("minio boto3 s3 oss2 cos-python storage-client", "Object Storage", "infrastructure", None, 0.7),
    ("pillow pil sharp imagemagick opencv-python", "Image Processing", "media", None, 0.7),
    ("pdf pypdf pdfplumber reportlab weasyprint pdf-lib", "PDF Processing", "media", None, 0.75),
    ("docx python-docx openpyxl xlsxwriter exceljs", "Office Document", "media", None, 0.7),
]
# What a complete product of a domain has.
COMPLETE: dict[str, list[str]] = {
    "ai": ["Text Generation", "Image Generation", "Video Generation", "Embedding", "Vector Search", "RAG", "Prompt Engineering", "Agent Orchestration", "Tool Calling", "Model Fine-tuning"],
    "web": ["Web Frontend", "Web API", "Authentication", "Realtime Communication", "UI Component Library", "Data Visualization", "Testing"],
    "data": ["Data Processing", "Relational Database", "ORM", "Caching", "Full-text Search", "Schema Migration", "Workflow Orchestration"],
    "infrastructure": ["Task Queue", "Message Queue", "Containerization", "Observability", "Testing", "CI/CD", "Object Storage"],
    "media": ["Image Processing", "Video Processing", "PDF Processing", "Office Document"],
}
# Words of a symbol's name that lower and raise its generality.
BUSINESS = "order invoice payment billing customer tenant employee salary contract cart checkout loyalty settlement warehouse shipment".split()
GENERIC = (
    "queue cache retry batch pipeline parser pool throttle debounce validator sanitize encode decode compress hash uuid pagination ratelimit circuit "
    "scheduler worker stream buffer tokenizer embedding http client logger config registry factory adapter middleware resolver dispatcher iterator merkle diff"
).split()
# Names of throw-away code.
DISPOSABLE_PREFIXES = "tmp temp debug_ dbg_ scratch wip_ hack_ xxx test_tmp foo bar baz dummy todo_ fixme_ old_ backup_ copy_of_ untitled".split()
DISPOSABLE_PARTS = "_bak _old _copy _v1_final _deprecated _unused".split()
# File extension by language.
EXTENSIONS: dict[str, str] = {
    "Rust": "rs", "Python": "py pyi", "JavaScript": "js jsx mjs cjs", "TypeScript": "ts tsx mts cts", "Go": "go", "Java": "java", "Kotlin": "kt kts",
    "Scala": "scala", "C": "c h", "C++": "cpp cc cxx hpp hh", "C#": "cs", "Swift": "swift", "Objective-C": "m", "Objective-C++": "mm", "Ruby": "rb",
    "PHP": "php", "Perl": "pl pm", "Lua": "lua", "R": "r", "Julia": "jl", "Dart": "dart", "Elixir": "ex exs", "Erlang": "erl", "Haskell": "hs",
    "Clojure": "clj cljs", "Elm": "elm", "Zig": "zig", "Nim": "nim", "Groovy": "groovy gradle", "Vue": "vue", "Svelte": "svelte", "CSS": "css",
    "SCSS": "scss", "Sass": "sass", "Less": "less", "Stylus": "styl", "SQL": "sql", "Shell": "sh bash zsh fish", "PowerShell": "ps1", "Batch": "bat",
    "YAML": "yaml yml", "TOML": "toml", "INI": "ini", "Protocol Buffers": "proto", "GraphQL": "graphql gql", "Markdown": "md mdx",
    "reStructuredText": "rst", "HTML": "html htm", "XML": "xml", "JSON": "json jsonc",
}
MARKUP = ["Markdown", "reStructuredText", "HTML", "XML", "JSON", "YAML", "TOML", "INI", "CSS", "SCSS", "Sass", "Less", "Stylus"]
# Files and folders that tools made.
GENERATED_FILES = (
    "package-lock.json yarn.lock pnpm-lock.yaml npm-shrinkwrap.json composer.lock cargo.lock poetry.lock pipfile.lock gemfile.lock pubspec.lock "
    "go.sum bun.lockb deno.lock uv.lock gradle.lockfile flask.lock build.gradle.lockfile"
).split()
GENERATED_ENDS = [".min.js", ".min.css", ".bundle.js", ".map"]
GENERATED_FOLDERS = "node_modules dist build out target .next .nuxt .output coverage __pycache__ .venv venv site-packages vendor .git min generated migrations".split()
# Never entered, never read.
EXCLUDED = (
    "node_modules bower_components vendor target build dist out .next .nuxt .output .turbo .cache .parcel-cache .gradle .mvn __pycache__ .pytest_cache "
    ".mypy_cache .ruff_cache .tox .venv venv env .eggs *.egg-info site-packages .git .svn .hg .idea .vscode .DS_Store Thumbs.db .env .env.local "
    ".env.production .env.development .npmrc .pypirc .netrc .aws .ssh id_rsa credentials secrets.json secrets.yaml keystore.jks"
).split()
SECRET_ENDS, SECRET_STARTS, SECRET_PARTS = [".pem", ".key", ".p12", ".pfx", ".keystore"], [".env"], ["secret", "credential", "token"]
# Marker file and kind of project, the first one found decides.
MARKERS = [
    ("Cargo.toml", "rust"), ("package.json", "node"), ("pyproject.toml", "python"), ("setup.py", "python"), ("go.mod", "go"), ("pom.xml", "java_maven"),
    ("build.gradle", "java_gradle"), ("build.gradle.kts", "java_gradle"), ("CMakeLists.txt", "cpp"), ("composer.json", "php"), ("Gemfile", "ruby"),
    ("pubspec.yaml", "dart"), ("requirements.txt", "python"), ("mix.exs", "elixir"), ("Package.swift", "swift"),
]
# Dependency, framework, weight; the heavier one is the more specific.
FRAMEWORKS = [
    ("tauri", "Tauri", 95), ("axum", "Axum", 90), ("actix-web", "Actix-web", 90), ("rocket", "Rocket", 88), ("bevy", "Bevy", 88), ("tokio", "Tokio", 40),
    ("fastapi", "FastAPI", 90), ("django", "Django", 92), ("flask", "Flask", 88), ("streamlit", "Streamlit", 85), ("gradio", "Gradio", 85),
    ("pytorch", "PyTorch", 80), ("torch", "PyTorch", 80), ("tensorflow", "TensorFlow", 80), ("scrapy", "Scrapy", 82), ("celery", "Celery", 75),
    ("langchain", "LangChain", 78), ("llama-index", "LlamaIndex", 78), ("next", "Next.js", 95), ("nuxt", "Nuxt", 95), ("react", "React", 70),
    ("react-dom", "React", 68), ("vue", "Vue", 72), ("svelte", "Svelte", 75), ("sveltekit", "SvelteKit", 90), ("@sveltejs/kit", "SvelteKit", 92),
    ("angular", "Angular", 85), ("@angular/core", "Angular", 92), ("express", "Express", 80), ("koa", "Koa", 80), ("nestjs", "NestJS", 85),
    ("@nestjs/core", "NestJS", 92), ("vite", "Vite", 60), ("electron", "Electron", 88), ("antd", "Ant Design", 55),
    ("github.com/gin-gonic/gin", "Gin", 88), ("github.com/labstack/echo", "Echo", 85), ("github.com/gofiber/fiber", "Fiber", 85),
    ("rusqlite", "SQLite", 50), ("sqlalchemy", "SQLAlchemy", 60), ("prisma", "Prisma", 62), ("typeorm", "TypeORM", 60), ("redis", "Redis", 45), ("mongodb", "MongoDB", 50),
]
FRAMEWORK_PREFIXES = [("spring-boot", "Spring Boot", 95), ("spring-", "Spring", 80), ("jakarta.", "Jakarta EE", 70)]


def rows(spark: SparkSession, values: list[tuple], names: list[str]) -> DataFrame:
    """A small literal table, without a Python worker."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in values])))


def capability_rules(spark: SparkSession) -> DataFrame:
    """rule, capability, domain, implementation, base, needle: one row a needle."""
    flat = [(i, cap, domain, impl or "", base, needle) for i, (needles, cap, domain, impl, base) in enumerate(CAPABILITIES) for needle in needles.split()]
    return rows(spark, flat, ["rule", "capability", "domain", "implementation", "base", "needle"]).withColumn("implementation", F.nullif("implementation", F.lit("")))
