"""Texts and limits that the reference SQL expects, written out apart from the operators that it checks."""

# The original tool's prompts, system texts and limits.
MIN_MAIN_BYTES = 100
PROMPT_HEAD = "Please summarize the following text"
STYLES = {
    "detailed": ". Provide a detailed summary that captures the main points, key arguments, and important details",
    "bullet_points": ". Format the summary as bullet points, highlighting the key information",
    "concise": ". Provide a concise summary focusing on the most important information",
}
OTHER_STYLE = ". Provide a clear and informative summary"
SUMMARY_SYSTEM = "You are a helpful assistant that creates clear, accurate summaries of text content."
KEYWORD_SYSTEM = "You extract key terms and phrases from text. Return only the keywords separated by commas."
KEYWORD_PROMPT = """Extract 5-10 key terms or phrases from the following text. Return only the keywords, separated by commas:

"""
ANALYSIS_HEAD = """Analyze this user request and determine if any tools should be called:

User Request: \""""
ANALYSIS_TAIL = """"

Instructions:
1. Decide if any of the available tools are needed based on their names, descriptions, and JSON schemas
2. If tools should be used, specify which ones and with what parameters
3. Provide reasoning for your decisions
4. Respond in JSON format as specified in the system prompt
5. Determine if postprocessing tool output is required, if yes, suggest the additional system prompt in verb e.g. Summarize, Recommend topic.
"""
SYSTEM_PROMPT = """You are an intelligent agent that helps users with tasks. You have access to the following tools:

[
  {
    "name": "scrape_url",
    "description": "Scrape content from a single URL and extract text, title, and metadata",
    "parameters": {
      "type": "object",
      "required": [
        "url"
      ],
      "properties": {
        "selector": {
          "type": "string",
          "description": "Optional CSS selector to extract specific content from the page"
        },
        "url": {
          "type": "string",
          "description": "The URL to scrape"
        }
      }
    }
  }
]

Your job is to analyze user requests and determine:
1. Whether any tools should be called to fulfill the request
2. Which specific tools to call and with what parameters
3. The reasoning behind your decisions

IMPORTANT: You must respond in valid JSON format with this exact structure:
{
	"message": "A helpful message to the user about what you understand from their request",
	"tool_calls": [
		{
			"name": "tool_name",
			"arguments": {
				"param1": "value1",
				"param2": "value2"
			},
			"reasoning": "Why this tool call is needed"
		}
	],
	"should_call": true/false,
	"confidence": 0.0-1.0,
	"explanation": "Detailed explanation of your analysis and decisions",
	"post_process": "Summarize"
}

Guidelines:
- If the user asks general questions that don't require web content, set "should_call" to false
- Be conservative: only call tools when clearly needed
- Provide clear reasoning for your decisions
- Extract parameters accurately from user input
- Set confidence based on how clear the user's intent is"""
