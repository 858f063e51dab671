"""Prompt text per approach and task (P12-P16) as Column expressions.

Prompts matter here only as the replay key (``sha2(prompt)``) and for input
token counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verity.functions.sqltext import _c

# FIXED VALUES: prompt wording and layout, indentation and blank lines included,
# since sha2(prompt) is the replay key. Those of one line are below.
SQL_RAW = """
            Generate a SQL query to solve the following:
            
            Table Information: {table_info}
            
            Question: {question}
            
            Return ONLY the SQL query without any explanations.
            Follow standard SQL syntax with the following guidelines:
            - Use proper spacing around operators and keywords
            - End your query with a semicolon
            - Use uppercase for SQL keywords (SELECT, FROM, WHERE, etc.)
            - Use lowercase for table and column names
            - For column aliases, use 'AS' keyword (e.g., COUNT(*) AS count)
            """
SQL_FEW_SHOT_HEAD = """
            Generate a SQL query based on the following examples:
            
            """
SQL_FEW_SHOT_EXAMPLE = """
                Table Information: {table_info}
                Question: {question}
                SQL: {query}
                
                """
SQL_FEW_SHOT_TAIL = """
            
            Now, generate a SQL query for:
            
            Table Information: {table_info}
            Question: {question}
            
            Return ONLY the SQL query without any explanations.
            """
SQL_FINE_TUNED = """
            Table: {table_info}
            Question: {question}
            SQL:
            """
CONTROLLED = """
            {operation_sentence}:
            Table Information: {table_info}
            Requirements: {question}
            
            Generate only the SQL query without any explanation.
            Ensure the query:
            1. Ends with a semicolon
            2. Uses proper SQL syntax
            3. Includes appropriate WHERE clauses for UPDATE/DELETE
            4. Uses proper data types for CREATE TABLE
            """
CONTROLLED_RETRY = "\nPrevious attempt was invalid. Please ensure proper SQL syntax."
OPERATION_SENTENCES = (
    ("select", "Generate a SELECT query to retrieve data"),
    ("insert", "Generate an INSERT query to add data"),
    ("update", "Generate an UPDATE query to modify data"),
    ("delete", "Generate a DELETE query to remove data"),
    ("create", "Generate a CREATE TABLE query"),
    ("alter", "Generate an ALTER TABLE query"),
)
TASK_RAW = (
    ("translation:german", "Translate the following English text to German. Return ONLY the translated text "
                           "without any explanations, notes, or the original text: "),
    ("translation:spanish", "Translate the following English text to Spanish. Return ONLY the translated text "
                            "without any explanations, notes, or the original text: "),
    ("sql", "Generate SQL query for the following requirement. Return ONLY the SQL query without any "
            "explanations or comments: "),
    ("json", "Convert this text to JSON. Return ONLY the JSON without any explanations or comments: "),
    ("sentiment", "Analyze the sentiment of each sentence in the given text. Return ONLY a JSON object with "
                  "counts: {positive:count, negative:count, neutral:count}"),
)
TASK_FEW_SHOT = (
    ("translation:german", """
                    Here are a few examples of English to German translations:
                    
                    English: Hello, how are you today?
                    German: Hallo, wie geht es dir heute?
                    
                    English: The weather is beautiful.
                    German: Das Wetter ist schön.
                    
                    English: I need to buy groceries.
                    German: Ich muss Lebensmittel kaufen.
                    
                    Now translate the following English text to German. Return ONLY the translated text:
                    """),
    ("translation:spanish", """
                    Here are a few examples of English to Spanish translations:
                    
                    English: Hello, how are you today?
                    Spanish: Hola, ¿cómo estás hoy?
                    
                    English: The weather is beautiful.
                    Spanish: El clima está hermoso.
                    
                    English: I need to buy groceries.
                    Spanish: Necesito comprar víveres.
                    
                    Now translate the following English text to Spanish. Return ONLY the translated text:
                    """),
    ("sql", """
                Here are a few examples of natural language to SQL query translations:
                
                Requirement: Find all users who are older than 30
                SQL: SELECT * FROM users WHERE age > 30;
                
                Requirement: Get the total sales for each product category
                SQL: SELECT category, SUM(sales) as total_sales FROM products GROUP BY category;
                
                Requirement: Update the status of all pending orders to 'processing'
                SQL: UPDATE orders SET status = 'processing' WHERE status = 'pending';
                
                Now generate a SQL query for the following requirement. Return ONLY the SQL query:
                """),
    ("json", """
                Here are a few examples of text to JSON conversions:
                
                Text: User John has age 30 and email john@example.com
                JSON: {"name": "John", "age": 30, "email": "john@example.com"}
                
                Text: Product Laptop has price $999 and is in stock
                JSON: {"product": "Laptop", "price": 999, "in_stock": true}
                
                Text: Order #1234 contains 2 items and was placed on 2023-01-15
                JSON: {"order_id": 1234, "items_count": 2, "date": "2023-01-15"}
                
                Now convert the following text to JSON. Return ONLY the JSON:
                """),
    ("sentiment", """
                Here are a few examples of sentiment analysis:
                
                Text: I love this product. It's amazing. The quality is excellent.
                Result: {"positive": 3, "negative": 0, "neutral": 0}
                
                Text: This is terrible. I hate it. The worst experience ever.
                Result: {"positive": 0, "negative": 3, "neutral": 0}
                
                Text: The product arrived on time. It works as expected. I might buy it again.
                Result: {"positive": 1, "negative": 0, "neutral": 2}
                
                Now analyze the sentiment of each sentence in the following text. Return ONLY a JSON object with counts:
                """),
)
TASK_FINE_TUNED = (
    ("translation:german", "Translate to German: "), ("translation:spanish", "Translate to Spanish: "),
    ("sql", "SQL: "), ("json", "JSON: "), ("sentiment", "Sentiment: "),
)
TASK_PROMPTS = {"raw": TASK_RAW, "few_shot": TASK_FEW_SHOT, "fine_tuned": TASK_FINE_TUNED}
SENTIMENT_PROMPT = "sentiment of this sentence is '{sentence}'"
SENTIMENT_RETRY = " in positive, negative and neutral is"
POEM_PROMPT = "generate me a five line poem with words :  '{words}'"
POEM_RETRY_LINES = ". You did wrong. The total number of lines must be five"
POEM_RETRY_WORDS = ". Poem must contains defined words"
POEM_APPEND = "generate me {diff} line poem whose previous line is {line}"


def fill(template: str, **cols) -> Column:
    """Substitute ``{name}`` placeholders with Columns (null-safe: a null
    value becomes the empty string, as an f-string of '' would)."""
    parts, rest = [], template
    while "{" in rest:
        i = rest.index("{")
        j = rest.index("}", i)
        name = rest[i + 1:j]
        if name not in cols:  # literal braces such as {positive:count}
            parts.append(F.lit(rest[:j + 1]))
            rest = rest[j + 1:]
            continue
        parts += [F.lit(rest[:i]), F.coalesce(_c(cols[name]).cast("string"), F.lit(""))]
        rest = rest[j + 1:]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def operation_sentence(operation) -> Column:
    m = F.create_map(*[F.lit(x) for kv in OPERATION_SENTENCES for x in kv])
    return m[F.lower(_c(operation))]


def sql_prompt(approach: str, table_info, question, operation=None, examples=None) -> Column:
    """P12-P15 for one SQL-benchmark approach. ``examples`` is a Column with
    the already-formatted few-shot block (see ``few_shot_block``)."""
    if approach == "raw":
        return fill(SQL_RAW, table_info=table_info, question=question)
    if approach == "fine_tuned":
        return fill(SQL_FINE_TUNED, table_info=table_info, question=question)
    if approach == "few_shot":
        return F.concat(F.lit(SQL_FEW_SHOT_HEAD), F.coalesce(_c(examples), F.lit("")),
                        fill(SQL_FEW_SHOT_TAIL, table_info=table_info, question=question))
    if approach == "controlled":
        return fill(CONTROLLED, operation_sentence=operation_sentence(operation), table_info=table_info,
                    question=question)
    raise ValueError(approach)


def few_shot_block(examples_df):
    """One-row DataFrame with the few-shot examples formatted in slot order
    (at most three rows in, so collecting them into one string is bounded)."""
    item = F.struct("slot", fill(SQL_FEW_SHOT_EXAMPLE, table_info="table_info", question="question",
                                 query="query").alias("text"))
    return examples_df.agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["text"]), "")
                           .alias("examples"))


def task_prompt(approach: str, task, text, language=None) -> Column:
    """P12/P14/P16 for the general benchmark: prompt prefix by task (and
    language for translation; unsupported languages fall back to German). An
    approach other than those of ``TASK_PROMPTS`` raises a KeyError."""
    table = TASK_PROMPTS[approach]
    m = F.create_map(*[F.lit(x) for kv in table for x in kv])
    lang = F.lower(F.coalesce(_c(language), F.lit("german")))
    lang = F.when(lang.isin("german", "spanish"), lang).otherwise(F.lit("german"))
    key = F.when(_c(task) == "translation", F.concat(F.lit("translation:"), lang)).otherwise(_c(task))
    return F.concat(m[key], F.lit(" " if approach == "few_shot" else ""), F.coalesce(_c(text), F.lit("")))
