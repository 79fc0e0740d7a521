"""Reports against texts written by hand."""

from orrery.operators import code, layouts

PROCEDURE = """# Análise de Procedure: `dbo.p`

## Resumo

- **Schema:** dbo
- **Procedure:** p
- **Linhas:** 2
- **Qtd. de tabelas detectadas:** 2
- **Qtd. de procedures chamadas:** 0
- **Qtd. de funções chamadas:** 0
- **Classificação:** `read_write`
- **Operações detectadas:** DELETE, SELECT

## Tabelas de leitura

- `a`
- `b`

## Tabelas de escrita

- `b`

## Temp tables

_Nenhuma temp table detectada._

## Table variables

_Nenhuma table variable detectada._

## Procedures chamadas

_Nenhuma chamada de procedure detectada._

## Funções chamadas

_Nenhuma função detectada._

## Variáveis declaradas

_Nenhuma variável declarada detectada._

## Recursos SQL Detectados

| Recurso | Detectado |
|---|---:|
| SQL dinâmico | Não |
| Cursor | Não |
| Transação | Não |
| TRY/CATCH | Não |
| NOLOCK | Sim |
| Temp table | Não |
| Table variable | Não |
| MERGE | Não |
| CTE | Não |

## Pontos de Atenção

- ⚠️ DELETE sem WHERE detectado

## Queries Extraídas


### SELECT

```sql
SELECT x FROM a WITH (NOLOCK);
```

### INSERT


### UPDATE


### DELETE

```sql
DELETE FROM b
```

### MERGE


## SQL da Procedure

```sql
SELECT x FROM a WITH (NOLOCK);
DELETE FROM b
```
"""

FACADE = """# Análise de Fachada: K

## Resumo

- **Arquivo analisado:** k.php
- **Classe:** K
- **Namespace:** App
- **Total de linhas:** 5
- **Métodos públicos:** 1
- **Dependências encontradas:** 1
- **Tabelas encontradas:** 1

## Pontos de atenção

- 1 método(s) público(s) contêm SQL embutido.

## Métodos públicos

- `public function go($a)` (linhas 3-4, chamadas 1): Executa ou monta SQL dentro do método.

## Dependências

- `Dep`

## Tabelas envolvidas

- `t`

## Métodos com SQL

- `go` — 1 bloco(s) SQL, 1 tabela(s) detectada(s)
"""

MODEL = """# Análise de Model: M

## Resumo

- **Arquivo analisado:** m.php
- **Classe:** M
- **Package:** não identificado
- **Author:** não identificado
- **SGBD:** ms
- **Tabela:** tb
- **Total de linhas:** 12
- **Campos encontrados:** 1
- **Métodos encontrados:** 1
- **Getters:** 1
- **Setters:** 0

## Pontos de atenção

- Nenhum ponto de atenção automático foi identificado.

## Chave primária

- `$id` → `id_m`

## Campos

- `$id` → `id_m` (linha 10, int)

## Getters

- `getId()`

## Setters

- Nenhum setter identificado.
"""

INCLUDE = """# Análise de Include — i.php

## Estatísticas

- **Linhas:** 3
- **Includes internos:** 1
- **Superglobais usadas:** $_GET
- **SQL suspeito:** 1
- **Actions encontradas:** 0
- **Funções declaradas:** 0
- **Classes declaradas:** 0
- **Tags HTML detectadas:** 1

## AJAX detectado

- `fetch`: 1

## Endpoints

- Nenhum endpoint encontrado.

## Includes internos

- `x.php`

## Actions

- Nenhuma action encontrada.

## SQL suspeito

- Linha 2 — `delete_from` — `DELETE FROM t`

## Scripts referenciados

- `s.js`

## CSS referenciados

- Nenhum CSS externo encontrado.

## Funções declaradas

- Nenhuma função declarada.

## Classes declaradas

- Nenhuma classe declarada.
"""


def only(df):
    (row,) = df.collect()
    return row["report"]


def test_reports_equal_texts_by_hand(spark):
    procedures = spark.createDataFrame([("dbo", "p", "SELECT x FROM a WITH (NOLOCK);\nDELETE FROM b")], "schema string, name string, definition string")
    assert only(layouts.procedure_reports(procedures)) == PROCEDURE
    facade = "<?php namespace App;\nclass K {\n  public function go($a) { $d = new Dep(); $d->x();\n $q = \"SELECT a FROM t\"; }\n}"
    files = spark.createDataFrame([("k.php", facade)], "path string, text string")
    assert only(layouts.facade_reports(code.facade_methods(files), files)) == FACADE
    model = "/**\n * @tabela tb\n * @SGBD ms\n */\nclass M {\n  /** @var int\n   * @campo id_m\n   * @primary sim\n   */\n  private $id;\n  public function getId() { return 1; }\n}"
    models = spark.createDataFrame([("m.php", model)], "path string, text string")
    assert only(layouts.model_reports(models, code.methods(models, aware=True))) == MODEL
    include = spark.createDataFrame([("i.php", "<?php include 'x.php'; $_GET; fetch(u);\nDELETE  FROM t\n<script src='s.js'></script>")], "path string, text string")
    assert only(layouts.include_reports(include)) == INCLUDE


def test_reports_are_written_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([("dbo", f"p{i}", "SELECT 1" if i else None) for i in range(5)], "schema string, name string, definition string")
    layouts.write_reports(layouts.procedure_reports(rows), str(tmp_path / "r"))
    found = sorted((tmp_path / "r").glob("name=*/part-*.txt"))
    assert [f.parent.name for f in found] == [f"name=dbo.p{i}" for i in range(5)] and found[1].read_text().startswith("# Análise de Procedure: `dbo.p1`\n")
    assert layouts.procedure_reports(rows.limit(0)).count() == 0
