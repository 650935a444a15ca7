"""Chat messages as array<struct<role, content>> columns.

System texts are parameters with fixed defaults; so are the ways in which contexts
are joined, which differ by builder.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopsmith.functions.text import SEPARATOR, clean_examples, stripped

# How each builder joins its passages.
JOINS = {"reader": "\n\n---\n\n", "passages": "\n\n", "documents": "\n", "facts": " ", "chat": "\n"}

# The instructions by task, which replies and scores depend on.
QA = """You are a precise question answering assistant.
Answer questions based on the relevant information within the provided context and ignore misleading text.
Keep your reasoning brief. Make your final answer as short as possible.
ALWAYS give your final answer after the words "Final Answer:"."""
GSM8K = """You are a precise solver of simple math problems.
Keep your reasoning very brief and concise.
Do not use scientific notation for your final answer.
Always end your response with "Final Answer: [your final answer]"."""
MATH = r"""You are a precise solver of math problems.
Keep your reasoning brief. Use LaTeX for mathematical operations and simplify the result.
Give the final answer in the format "\\boxed{final_answer}"."""
HELLASWAG = """Select the option that most logically follows from the context.
The entire final answer must be a single letter: A, B, C, or D."""
XLSUM = """Write a concise abstractive summary of the news article.
Usually use one sentence and return only the summary."""
MMLU_PRO = """Solve the professional-level multiple-choice question.
The entire final answer must be a single letter from A to J."""
INFORMATION_GAIN = """You are a precise question answering assistant used to estimate information gain.
Answer questions based ONLY on the relevant information within the provided context and ignore misleading text.
Make your final answer as short as possible.
Give me your short and precise final answer
"""
UNCERTAINTY = """You are a precise question answering assistant.
Answer questions based ONLY on the relevant information within the provided context and ignore misleading text.
Make your final answer as short as possible.
Give me your short and precise final answer
"""
FACTOID = """You are a factoid question answering system.
Return only the answer itself.
The answer must be a single entity, number, date, yes/no, or short phrase.
No explanations, no reasoning, no extra text.
Do not write labels such as 'Final answer:' or 'Answer:'."""
JUDGE = """You are an answer verification system for question-answering tasks.
You are given a QUESTION, PREDICTED ANSWER and GROUNDTRUTH ANSWER.
Compare the predicted and ground-truth answers for semantic equivalence.
Ignore harmless wording, formatting, numeric, and date representation differences.
If the predicted answer is only partially correct or misses key information, mark it incorrect.
Your final answer must be exactly "Final Answer: CORRECT" or "Final Answer: INCORRECT"."""
SHORT_REASONS = "You are a precise question answering assistant. Keep your reasoning brief. "
CONCISE = "You are a helpful assistant. Answer concisely."
STORY = "Your are an AI assistant, your job is to answer questions given to you by the user."
SYSTEM = {
    "HotPotQA": QA, "Musique": QA, "2WikiMultihopQA": QA, "HotPotQA+2WikiMultihopQA": QA, "NQ+HotPotQA": QA, "GSM8K": GSM8K, "MATH": MATH,
    "HellaSwag": HELLASWAG, "XL-Sum": XLSUM, "MMLU-Pro": MMLU_PRO, "SSIG": INFORMATION_GAIN, "SEP": UNCERTAINTY,
}
# The instructions before documents, and without any.
BY_DOCUMENTS = "Answer the question based on the given document. Only give me the answer and do not output any other words.\nThe following are given documents.\n"
BY_KNOWLEDGE = "Answer the question based on your own knowledge. Only give me the answer and do not output any other words.\n"


def system_text(task: Column, texts: dict[str, str] | None = None) -> Column:
    pairs = [F.lit(x) for kv in (texts or SYSTEM).items() for x in kv]
    return F.element_at(F.create_map(*pairs), task)


def messages(system: Column | str, user: Column) -> Column:
    system = F.lit(system) if isinstance(system, str) else system
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def filled(template: str, **columns: Column) -> Column:
    """The template with {name} places taken by columns."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), columns[name]]
    return F.concat(*out, F.lit(rest))


# Fixed value: layout of the short-answer question.
SHORT_ANSWER = "GIVEN PASSAGES:\n{context}\n\nQUESTION:\n{question}\n\nReturn only the short answer."


def short_answer_messages(question: Column, context: Column, system: str = FACTOID) -> Column:
    return messages(system, filled(SHORT_ANSWER, context=context, question=question))


def reward_messages(question: Column, chunks: Column, leading_line: bool, system: str = FACTOID) -> Column:
    """What a reward scores an answer against. Step and gold-shift rewards begin with an
    empty line, candidate betas and their reward don't: the two are different scales."""
    return messages(system, filled("\n" * leading_line + SHORT_ANSWER, context=F.array_join(chunks, JOINS["passages"]), question=question))


# The user turns of chat clients.
CHAT = "CONTEXT:\n{context}\n\nQUESTION:\n{question}\n\nFinal Answer:"
JUDGED = "QUESTION: {question}\nPREDICTED ANSWER: {prediction}\nGROUNDTRUTH ANSWER: {answer}"


def chat_messages(question: Column, passages: Column, system: str = QA) -> Column:
    return messages(system, filled(CHAT, context=F.array_join(passages, JOINS["chat"]), question=question))


def judge_messages(question: Column, prediction: Column, answer: Column, system: str = JUDGE) -> Column:
    return messages(system, filled(JUDGED, question=question, prediction=prediction, answer=answer))


def example_messages(question: Column, examples: Column, system: str = GSM8K) -> Column:
    """Turns of ``prepared_examples`` before the question."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    shown = F.flatten(F.transform(examples, lambda e: F.array(turn("user", e["question"]), turn("assistant", e["answer"]))))
    return F.concat(F.array(turn("system", F.lit(system))), shown, F.array(turn("user", question)))


def reader_messages(question: Column, chunks: Column, system: str = FACTOID) -> Column:
    return messages(system, filled("\n" + SHORT_ANSWER, context=F.array_join(chunks, JOINS["reader"]), question=question))


def passage_messages(question: Column, chunks: Column, system: str = SYSTEM["HotPotQA"]) -> Column:
    asked = F.concat(F.lit("Question: "), question)
    given = F.concat(F.lit("Below are passages you should use:\n\n"), F.array_join(chunks, JOINS["passages"]), F.lit("\n\n"), asked)
    return messages(system, F.when(F.size(chunks) > 0, given).otherwise(asked))


def document_messages(question: Column, chunks: Column, system: str = CONCISE) -> Column:
    asked = F.concat(F.lit("Question: "), question)
    given = F.concat(F.lit(BY_DOCUMENTS), F.array_join(chunks, JOINS["documents"]), F.lit("\n"), asked)
    return messages(system, F.when(F.size(chunks) > 0, given).otherwise(F.concat(F.lit(BY_KNOWLEDGE), asked)))


# Fixed value: layout of a story's prompt.
STORY_TASK = "{instruction}\n{examples}\n{closing}\nContext: {context}\n\nQuestion: {question}?"


def story_task(name: Column) -> Column:
    """The task of a data set's name: what stands before its first underscore."""
    return F.substring_index(name, "_", 1)


def story_task_messages(question: Column, facts: Column, instruction: Column, examples: Column, closing: Column) -> Column:
    """A story prompt by its task's texts (columns, so that a table of tasks can be joined); example
    marks become words."""
    shown = clean_examples(examples)
    return messages(STORY, stripped(filled(STORY_TASK, instruction=instruction, examples=shown, closing=closing, context=F.array_join(facts, JOINS["facts"]), question=question)))


# Fixed value: the yes/no judge's question.
YES_NO = """You are evaluating answer correctness.

Question: {question}
Expected answer: {answer}
Proposed answer: {prediction}

Does the proposed answer convey the same meaning as the expected answer in the context of the question? Respond with ONLY 'yes' or 'no'."""


def yes_no_messages(question: Column, answer: Column, prediction: Column, template: str = YES_NO) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), filled(template, question=question, answer=answer, prediction=prediction).alias("content")))


# The prompts of tasks.
TASK_QA = """There is a context which is crucial to answer question '{question}':
{context}

Carefully read information above and answer the question: {question}
YOUR ANSWER: """
TASK_SUMMARY = """There is a context you need to summarize into comprehensive and short paragraphs:
{context}

Carefully read information above and summarize it into one, two or three paragraphs of text. 
This summary must be expressive and accurate.
YOUR SUMMARY: """


def task_prompt(kind: Column, context: Column, question: Column, answer: Column | None = None) -> Column:
    """A task's prompt by its kind (qa or summary), with its answer if that is given."""
    asked = {"qa": filled(TASK_QA, context=context, question=question), "summary": filled(TASK_SUMMARY, context=context)}
    prompt = F.when(kind == "qa", asked["qa"]).when(kind == "summary", asked["summary"])
    return prompt if answer is None else F.concat(prompt, answer)


def story_messages(question: Column, facts: Column, template: str, system: str = STORY) -> Column:
    return messages(system, stripped(filled(template, context=F.array_join(facts, JOINS["facts"]), question=question)))


def prepared_examples(examples: Column) -> Column:
    """struct(question, answer) of those examples that have both parts."""
    parts = F.transform(examples, lambda e: F.split(e, F.lit(r"\Q" + SEPARATOR + r"\E"), 2))
    both = F.filter(parts, lambda p: F.size(p) == 2)
    return F.transform(both, lambda p: F.struct(stripped(p[0]).alias("question"), stripped(p[1]).alias("answer")))
